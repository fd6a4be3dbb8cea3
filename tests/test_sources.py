import pytest
from pyspark.sql import functions as F

from voucherlake.plans import source_queries
from voucherlake.sources import files, sinks, xml


def test_listing_and_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" 第一行 \r\n\n第二行", encoding="utf-8")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "b.ofd").write_text("x")
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "c.txt").write_text("x")
    listed = {r.file.rsplit("/", 1)[1]: (r.file_type, r.supported) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.txt": ("text", True), "empty.md": ("markdown", True), "b.ofd": ("unknown", False)}
    docs = {r.source_file.rsplit("/", 1)[1]: r for r in files.scan_texts(spark, str(tmp_path)).collect()}
    assert docs["a.txt"].lines == ["第一行", "第二行"] and docs["a.txt"].status == "ready"
    assert docs["empty.md"].status == "failed"


def test_text_files_of_any_name(spark, tmp_path):
    names = ["with space.txt", "B.TXT", "50%25 off.Md", "发票.txt", "a#b?c.md", "plus+.txt"]
    for name in names:
        (tmp_path / name).write_text(f"text of {name}", encoding="utf-8")
    (tmp_path / "EMPTY.TXT").write_text("")
    docs = {r.source_file.rsplit("/", 1)[1]: r for r in files.scan_texts(spark, str(tmp_path)).collect()}
    assert {n: docs[n].lines for n in names} == {n: [f"text of {n}"] for n in names}
    assert docs["EMPTY.TXT"].status == "failed" and len(docs) == len(names) + 1


def test_spans_without_order_are_refused(spark):
    with pytest.raises(ValueError, match="order"):
        files.scan_spans(spark.createDataFrame([("u", "a")], "unit_id string, text string"))


def test_xml_values_as_a_parser_gives_them(spark):
    body = ("<a><!-- <SellerName>no</SellerName> --><SellerName><![CDATA[甲<&amp;公司]]></SellerName><BuyerName>&#30002;&#x516c;&amp;#30002;"
            "</BuyerName><EIid>7</EIid></a>")
    rai = '<x xmlns="http://n/rai"><r:NameOfPurchaser><![CDATA[乙]]></r:NameOfPurchaser>'
    df = spark.createDataFrame([("ok", "f", body)], "unit_id string, source_file string, xml string")
    one = xml.scan_einvoice_xml(df)[0].first()
    assert (one.seller_name, one.buyer_name) == ("甲<&amp;公司", "甲公&#30002;")
    df = spark.createDataFrame([("good", "f", rai.replace("r:", "") + "</x>"), ("cut", "f", rai), ("efi", "f", "<x u='/efi'/>")], df.schema)
    invoices, _, failed, left = xml.scan_xbrl(df)
    assert [r.buyer_name for r in invoices.collect()] == ["乙"]
    assert [r.unit_id for r in failed.collect()] == ["cut"]
    assert [(r.unit_id, r.taxonomy) for r in left.collect()] == [("efi", "efi")]


def test_xml_values_of_any_length(spark):
    """Values of a megabyte, with references, comments and character data in them, in records, lines and XBRL instances."""
    long = "长" * 1_000_000
    text = (f"<a><!--{long}--><SellerName x='/y' z=\"1/2\">{long}&lt;<![CDATA[{long}]]]]><![CDATA[>{long}]]></SellerName><BuyerName  /><EIid>\n 7 </EIid >"
            f"<EIid>8</EIid><IssuItemInformation><ItemName>{'&#30002;' * 2000}{long}</ItemName><Amount>1.5</Amount></IssuItemInformation></a>")
    schema = "unit_id string, source_file string, xml string"
    invoices, lines, failed = xml.scan_einvoice_xml(spark.createDataFrame([("u", "f", text)], schema))
    one = invoices.first()
    assert (one.seller_name, one.buyer_name, one.invoice_no) == (f"{long}<{long}]]>{long}", None, "7")
    assert lines.first().item_name == "甲" * 2000 + long and failed.count() == 0
    rai = f'<x xmlns="http://n/rai" xmlns:r="http://r"><r:NameOfPurchaser/><q:NameOfPurchaser xmlns:q="u">{long}</q:NameOfPurchaser></x>'
    assert xml.scan_xbrl(spark.createDataFrame([("u", "f", rai)], schema))[0].first().buyer_name == long


def test_ocr_polygons_become_boxes(spark):
    df = spark.sql("""select 'u' unit_id, array('a', ' ', 'b') texts, array(0.9D, 0.8D, 1.5D) scores,
        array(array(array(1D, 2D), array(5D, 2D), array(5D, 9D)), array(array(0D, 0D)), array(array(3D, 4D))) polys""")
    rows = files.scan_ocr(df).orderBy("ord").collect()
    assert [(r.ord, r.text, r.x0, r.y0, r.x1, r.y1, r.confidence) for r in rows] == [
        (1, "a", 1.0, 2.0, 5.0, 9.0, 0.9), (3, "b", 3.0, 4.0, 3.0, 4.0, None)]


def test_malformed_xml_fails_alone(spark):
    df = spark.createDataFrame([("ok", "f", "<a><EIid>7</EIid><IssuItemInformation/></a>"), ("cut", "f", "<a><EIid>7</EI"), ("text", "f", "no xml")],
                               "unit_id string, source_file string, xml string")
    invoices, lines, failed = xml.scan_einvoice_xml(df)
    assert [r.invoice_no for r in invoices.collect()] == ["7"]
    assert lines.count() == 1
    assert sorted(r.unit_id for r in failed.collect()) == ["cut", "text"]


def test_append_is_idempotent_and_never_overwrites(spark, tmp_path):
    events = spark.sql("select id event_id, id % 3 user_id, 'view' event_type, cast(id % 4 as double) value from range(24)")
    rows = source_queries.event_rows(events)
    path = str(tmp_path / "ledger")
    first = sinks.append_ledger(rows, path, source_queries.EVENT_ORDER)
    second = sinks.append_ledger(rows.orderBy(F.rand(3)), path, source_queries.EVENT_ORDER)
    # of two equal rows of the batch the first is added and the second repeats it
    assert sorted((r.action, r.n_rows) for r in first.collect()) == [("added", 1)] * 12 + [("skipped", 1)] * 12
    assert {r.action for r in second.collect()} == {"skipped"}
    table = spark.read.parquet(f"{path}/rows")
    assert table.count() == 12 and sorted(r.row_sequence for r in table.collect()) == list(range(1, 13))
    try:
        sinks.append_ledger(rows, path, source_queries.EVENT_ORDER, replace_existing=True)
        raise AssertionError("an overwrite must be refused")
    except ValueError:
        pass


def test_weak_rows_are_written_and_flagged(spark, tmp_path):
    events = spark.sql("select 1 event_id, 1 user_id, 'view' event_type, 2.0D value")
    rows = source_queries.event_rows(events).withColumn("invoice_no", F.lit(None).cast("string"))
    path = str(tmp_path / "weak")
    sinks.append_ledger(rows, path, source_queries.EVENT_ORDER)
    again = sinks.append_ledger(rows, path, source_queries.EVENT_ORDER)
    assert [r.action for r in again.collect()] == ["added_weak"]
    remarks = [r.context_remark for r in spark.read.parquet(f"{path}/rows").orderBy("row_sequence").collect()]
    assert remarks == ["", "疑似重复（弱身份票），请人工确认"]


def test_evidence_and_run_artefacts(spark, tmp_path):
    rows = spark.sql("select 'a' unit_id, 'ready' recognition_status, '' review_remark union all select 'b', 'review_required', 'x'")
    invoices = spark.sql("select 'a' unit_id, 'ready' status union all select 'b', 'ready' union all select 'c', 'failed'")
    sinks.write_evidence("r1", str(tmp_path), rows, invoices, texts=spark.sql("select 'b' unit_id, 'line' text"))
    got = spark.read.json(f"{tmp_path}/evidence")
    assert sorted((r.part, r.unit_id) for r in got.collect()) == [
        ("invoice_record", "b"), ("invoice_record", "c"), ("ledger_rows", "b"), ("texts", "b")]
    sinks.write_run_summary(spark.sql("select 3 as input_count"), "r1", str(tmp_path))
    assert spark.read.json(f"{tmp_path}/run_summary").first().input_count == 3
