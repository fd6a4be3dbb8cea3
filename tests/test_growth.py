"""Steps whose cost must follow the input: joins by unit, and folds over the lines of a document."""

import datetime

from pyspark.sql import functions as F

from voucherlake.functions import text as T
from voucherlake.functions import keys as K
from voucherlake.operators import checks
from voucherlake.operators import geometry as G
from voucherlake.operators import items as I
from voucherlake.operators import ledger
from voucherlake.operators import placed
from voucherlake.operators.extract import visual_totals
from voucherlake.plans import document_queries, ledger_queries, source_queries

SPAN = "unit_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def test_no_table_by_unit_goes_through_the_driver(spark):
    """Small as it is, the table of edges is not broadcast: its size follows the number of units."""
    spans = spark.createDataFrame([(1, 1, 1, "项目名称", 0.0, 0.0, 9.0, 9.0, None), (1, 1, 2, "金额", 20.0, 0.0, 29.0, 9.0, None)], SPAN)
    columns = {"项目名称": "item_name", "金额": "line_amount"}
    rows = G.visual_rows(spans, top=True)
    edges = G.column_edges(rows, G.header_rows(rows, columns), columns)
    found = G.assign_columns(rows, edges)
    assert sorted((r.ord, r.column) for r in found.collect()) == [(1, "item_name"), (2, "line_amount")]
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_totals_of_a_page_with_a_wide_gap(spark):
    visual = "array<struct<page:int,y0:double,x0:double,y1:double,boxed:boolean,t:string,confidence:double>>"
    rows = [(1, [(1, 0.0, 0.0, 10.0, True, "合计 ¥10.00 ¥1.30", None), (1, 20.0, 0.0, 30.0, True, "价税合计（小写）", None), (1, 41.0, 0.0, 51.0, True, "¥11.30", None)]),
            (2, [(1, 0.0, 0.0, 10.0, True, "价税合计（小写）", None), (1, 40.0, 0.0, 50.0, True, "¥11.30", None)]),
            (3, [(1, 0.0, 0.0, 10.0, True, "备注", None)]), (4, [])]
    docs = spark.createDataFrame(rows, f"unit_id int, visual {visual}")
    found = {r.unit_id: [(c.field, c.value) for c in r.f] for r in docs.select("unit_id", visual_totals(F.col("visual"), F.lit("pdf_text")).alias("f")).collect()}
    assert found == {1: [("amount_total", "10.00"), ("tax_total", "1.30"), ("total_with_tax", "11.30")], 2: [], 3: [], 4: []}


def test_lines_without_a_digit_between_items(spark):
    lines = ["表头", "*商品*甲", "续名", "个", "1", "10.00", "10.00", "13%", "1.30", "脚注", "*商品*乙 台 1 5.00 5.00 13% 0.65"]
    docs = spark.createDataFrame([(lines,)], "lines array<string>")
    units, specs = F.array(F.lit("个")), F.array().cast("array<string>")
    (row,) = docs.select(I.sequence_items(F.col("lines"), units, specs).alias("i")).collect()
    assert [(i.item_name, i.line_amount, i.line_tax_amount) for i in row.i] == [("*商品*甲续名", "10.00", "1.30"), ("*商品*乙", "5.00", "0.65")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"


def order_rows(spark, folder, n):
    day = datetime.date(1995, 1, 2)
    rows = [(i, i % 7, "F", 100.0 + i, day, "1-URGENT") for i in range(n)]
    spark.createDataFrame(rows, ORDER).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_parts_of_documents_follow_their_number(spark, tmp_path, monkeypatch):
    folder = order_rows(spark, tmp_path, 90)
    monkeypatch.setattr(document_queries, "TASK_DOCUMENTS", 10, raising=False)
    found = document_queries.orders(spark, folder)
    assert found.rdd.getNumPartitions() >= 9 and found.count() == 90


PARTIES = [("购 买 方", 20.0, 100.0), ("销售方信息", 310.0, 100.0), ("名称：甲乙有限公司", 50.0, 100.0), ("名称：丙丁公司", 340.0, 100.0),
           ("识别号：91B000000000000001", 50.0, 120.0), ("识别号：91S000000000000001", 340.0, 120.0), ("项目名称", 50.0, 200.0), ("戊己公司", 50.0, 230.0)]
FOUND = {("buyer_name", "甲乙有限公司"), ("seller_name", "丙丁公司"), ("buyer_tax_id", "91B000000000000001"), ("seller_tax_id", "91S000000000000001")}


def test_party_columns_shuffle_spans_once(spark):
    rows = [(u, 1, i, t, x, y, x + 100, y + 12, None) for u in (1, None) for i, (t, x, y) in enumerate(PARTIES)]
    # Without a table below, a name under the first tax id of its column is none.
    rows += [(2, 1, i, t, x, y, x + 100, y + 12, None) for i, (t, x, y) in enumerate(PARTIES[:2] + PARTIES[4:6] + [("庚辛公司", 50.0, 150.0)])]
    found = G.column_parties(spark.createDataFrame(rows, SPAN))
    assert {(r.field, r.value) for r in found.filter("unit_id = 1").collect()} == FOUND
    assert {r.field for r in found.filter("unit_id = 2").collect()} == {"buyer_tax_id", "seller_tax_id"}
    assert found.filter("unit_id is null").count() == 0
    assert "Join" not in plan(found) and plan(found).count("Exchange") == 1


def test_spans_carry_the_kinds_of_their_unit(spark):
    docs = spark.createDataFrame(
        [(u, [(1, 1, "甲", 1.0, 1.0, 9.0, 9.0, None)]) for u in ("a", "a", "b", "c", None)],
        "unit_id string, spans array<struct<page:int,ord:int,t:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>")
    kinds = spark.createDataFrame(
        [("a", "x", None, "ocr"), ("a", "y", "v", "pdf"), ("b", "y", None, "pdf"), (None, "y", "v", "pdf")],
        "unit_id string, schema_id string, variant_id string, source string")
    spans = placed.span_table(docs, kinds)

    def units(test):
        return sorted(r.unit_id for r in placed._of(spans, test).collect())

    assert units(placed._typed(["y"])) == ["a", "a", "b"] and units(placed._typed(["y"], "v")) == ["a", "a"]
    assert units(lambda kind: kind["source"] == "ocr") == ["a", "a"] and units(placed._typed(["z"])) == []


def test_end_of_a_second_table_is_told_without_a_join(spark):
    printed = [("甲", 0.0, 10.0), ("乙", 100.0, 10.0), ("一", 0.0, 30.0), ("二", 100.0, 30.0), ("备注", 0.0, 60.0), ("三", 0.0, 80.0), ("四", 100.0, 80.0)]
    spans = spark.createDataFrame([(u, 1, i, t, x, y, x + 20, y + 10, None) for u in (1, 2) for i, (t, x, y) in enumerate(printed)], SPAN)
    found = G.sub_table_rows(spans, {"p": ["甲"], "q": ["乙"]}, ["甲", "乙"], ["备注"])
    assert sorted((r.unit_id, r.row_no, r.p, r.q) for r in found.collect()) == [(1, 1, "一", "二"), (2, 1, "一", "二")]
    # One join takes the header to the rows; before, limits took a second, and the numbering did all twice.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_identity_words_in_any_line(spark):
    rows = spark.createDataFrame([("纳税人 识别号 ab12",), ("身份证abc",), ("发票号码 AB",), (None,)], "t string")
    found = rows.select(T.identity_context(F.col("t")).alias("f"))
    assert [r.f for r in found.collect()] == [True, True, False, None]
    assert "upper" not in plan(found)


def test_checks_of_structured_records_do_not_read_the_xml_again(spark, tmp_path):
    found = source_queries.structured_checks(spark, order_rows(spark, tmp_path, 3))
    assert found.count() == 3
    assert "regexp_extract_all" not in found._jdf.queryExecution().analyzed().toString()


def test_amount_checks_read_headers_and_lines_once(spark, tmp_path):
    money = "decimal(18,2)"
    invoices = spark.sql("select 'u' unit_id, 's' schema_id union all select 'v', 't' union all select 'w', null").selectExpr(
        "*", f"cast(1 as {money}) amount_total", f"cast(null as {money}) tax_total", f"cast(3 as {money}) total_with_tax")
    lines = spark.sql(f"""select id unit_id, 1 line_no, cast(2 as {money}) line_amount, cast(1 as {money}) line_tax_amount,
        cast(9 as {money}) line_total_with_tax, cast(5 as {money}) quantity, cast(5 as {money}) unit_price from values ('u'), ('u'), ('v'), (null) t(id)""")
    for name, table in (("invoices", invoices), ("lines", lines)):
        table.write.parquet(f"{tmp_path}/{name}")
    invoices, lines = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("invoices", "lines"))
    found = checks.amount_checks(invoices, lines, {"s": list(checks.AMOUNT_CHECKS)})
    # Headers once; lines for their own checks and for the sums.
    assert plan(found).count("FileScan") == 3
    remarks = {r.unit_id: (r.n_issues, r.issue_remark) for r in checks.issue_remarks(found, once=True).collect()}
    line = "line 1: line_amount + line_tax_amount != line_total_with_tax; line 1: quantity * unit_price != line_amount"
    assert remarks["u"] == (4, f"incomplete amount breakdown: missing tax_total; {line}; sum line_amount != amount_total")
    assert remarks["v"] == remarks[None] == (2, line) and "w" not in remarks
    again = {r.unit_id: r.n_issues for r in checks.issue_remarks(found).collect()}
    assert again["u"] == remarks["u"][0] + 2 and again["v"] == 2


def test_a_summary_builds_only_the_columns_asked_for(spark, tmp_path):
    rows = [("a", "明细", 2, "x"), ("a", "明细", 1, "y"), ("b", "明细", 1, "x"), ("b", "汇总", 3, "y"), ("b", "汇总", 4, "z"), (None, None, None, "n"), (None, "明细", 7, "m")]
    spark.createDataFrame(rows, "invoice_key string, row_type string, line_no int, remark string").write.parquet(f"{tmp_path}/rows")
    found = ledger.invoice_summary(spark.read.parquet(f"{tmp_path}/rows"), ["line_no"])
    shown = {tuple(r) for r in found.select("invoice_key", "line_no", "remark").collect()}
    assert shown == {("a", 1, "y"), ("b", 4, "z"), (None, None, "n")}
    assert "remark" not in plan(found.select("invoice_key", "line_no"))


def test_fingerprints_of_amounts_drop_closing_zeros(spark):
    values = ["10.50", "10.00", "100.00", "0.00", "-0.10", "10.05", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("decimal(18,2)").alias("line_amount"))
    plain = spark.createDataFrame([(v,) for v in ("10.5", "10", "100", "0", "-0.1", "10.05", "")], "line_amount string")
    said = [r.f for r in rows.select(K.row_fingerprint(rows).alias("f")).collect()]
    assert said == [r.f for r in plain.select(K.row_fingerprint(plain).alias("f")).collect()] and said[-1] is None


def test_rows_to_number_are_not_joined_again(spark, tmp_path, monkeypatch):
    """Numbering reads its rows three times; the joins that made them are done once."""
    folder = order_rows(spark, tmp_path, 5)
    spark.sql("select cast(id as long) c_custkey, concat('c', id) c_name from range(7)").write.parquet(f"{folder}/customer.parquet")
    spark.sql("""select id % 5 l_orderkey, id l_partkey, id l_suppkey, cast(id % 3 as int) l_linenumber, 2D l_quantity, 10D l_extendedprice, 0.1D l_discount,
        0.05D l_tax, 'N' l_returnflag, 'O' l_linestatus, if(id < 6, timestamp'1996-05-01', timestamp'1998-05-01') l_shipdate from range(10)""").write.parquet(f"{folder}/lineitem.parquet")
    given, number = [], ledger.number_rows
    monkeypatch.setattr(ledger, "number_rows", lambda rows, order: given.append(rows) or number(rows, order))
    history, _ = ledger_queries._history(spark, folder)
    assert "Join" not in plan(given[0])
    assert sorted(r.row_sequence for r in history.collect()) == [1, 2, 3, 4, 5, 6]
