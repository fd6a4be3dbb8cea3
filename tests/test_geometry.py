from pyspark.sql import functions as F

from voucherlake.operators import doc_text as X
from voucherlake.operators import extract as E
from voucherlake.operators import geometry as G

SPAN = "unit_id string, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def test_visual_rows_are_anchored_to_their_first_span(spark):
    # 0, 6, 12 with reach 8: 12 is near 6 but not near the anchor 0.
    rows = spark.createDataFrame([("u", 1, i, str(i), 0.0, y, 5.0, y + 10, None) for i, y in enumerate((1.0, 7.0, 13.0, 40.0))], SPAN)
    got = {r.ord: r.anchor for r in G.visual_rows(rows, 8.0).collect()}
    assert (got[0], got[1], got[2], got[3]) == (6.0, 6.0, 18.0, 45.0)


def test_arrays_and_tables_give_the_same_lines(spark):
    values = [("u", 1, i, f"t{i}", float(i * 37 % 100), float(i * 53 % 211) + 1, float(i * 37 % 100 + 5), float(i * 53 % 211) + 11, None) for i in range(60)]
    rows = spark.createDataFrame(values, SPAN)
    table = sorted(r.text for r in G.visual_lines(G.visual_rows(rows, 8.0)).collect())
    docs = rows.groupBy("unit_id").agg(F.collect_list(F.struct("text", "page", F.col("ord").alias("order"), "x0", "y0", "x1", "y1")).alias("blocks"))
    lines = X.from_blocks(docs).select(F.explode(X.visual_lines(F.col("spans"), 8.0)).alias("l")).select("l.t").collect()
    assert sorted(r.t for r in lines) == table


def test_totals_on_visual_rows(spark):
    blocks = [("合", 50, 100), ("计", 80, 100), ("100.00", 200, 100), ("13.00", 300, 100), ("价税合计（小写）", 50, 150), ("113.00", 200, 161)]
    df = spark.createDataFrame([("u", [(t, float(x), float(y), float(x + 40), float(y + 12)) for t, x, y in blocks])],
                               "unit_id string, blocks array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")
    docs = E.annotate_documents(X.from_blocks(df))
    found = docs.select(E.visual_totals(F.col("visual"), F.lit("pdf_text")).alias("f")).first().f
    assert {c.field: c.value for c in found} == {"amount_total": "100.00", "tax_total": "13.00", "total_with_tax": "113.00"}


def test_the_pair_that_adds_up_wins_over_a_page_subtotal(spark):
    blocks = [("小 计 ¥5.00", 50, 60), ("计 ¥1718849.19 ¥223450.39", 50, 100), ("价税合计（小写）¥1942299.58", 50, 130)]
    df = spark.createDataFrame([("u", [(t, float(x), float(y), float(x + 40), float(y + 12)) for t, x, y in blocks])],
                               "unit_id string, blocks array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")
    docs = E.annotate_documents(X.from_blocks(df))
    found = docs.select(E.visual_totals(F.col("visual"), F.lit("pdf_text")).alias("f")).first().f
    assert {c.field: c.value for c in found} == {"amount_total": "1718849.19", "tax_total": "223450.39", "total_with_tax": "1942299.58"}


def test_table_items_at_any_scale(spark):
    heads = ["项目名称", "金额", "税率", "税额"]
    for scale in (0.5, 1, 3):
        rows = []
        for i, (head, dy) in enumerate(zip(heads, (0, -2, -1, 0))):
            rows.append((head, 100 * i, 250 + dy))
        rows += [("*服务*甲", 0, 300), ("100.00", 100, 300), ("13%", 200, 300), ("13.00", 300, 300), ("合计", 0, 340)]
        spans = [("u", 1, n, t, float(x * scale), float(y * scale), float((x + 40) * scale), float((y + 12) * scale), None) for n, (t, x, y) in enumerate(rows)]
        got = G.table_items(G.visual_rows(spark.createDataFrame(spans, SPAN), top=True), {"item_name": ["项目名称"], "line_amount": ["金额"], "tax_rate": ["税率"], "line_tax_amount": ["税额"]}).collect()
        assert [(r.item_name, str(r.line_amount), r.tax_rate, str(r.line_total_with_tax)) for r in got] == [("*服务*甲", "100.00", "13%", "113.00")]
