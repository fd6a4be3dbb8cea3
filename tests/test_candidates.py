from pyspark.sql import functions as F

from voucherlake.operators import candidates as C

SCHEMA = "unit_id string, field string, pos int, value string, confidence double, evidence string, risks array<string>"


def test_same_value_keeps_its_place_and_the_better_evidence(spark):
    rows = spark.createDataFrame([("u", "a", 0, "x", 0.84, "low", ["weak_geometry"]), ("u", "a", 1, "x", 0.99, "high", [])], SCHEMA)
    got = C.upsert(rows).collect()
    assert len(got) == 1 and (got[0].pos, got[0].confidence, got[0].evidence, got[0].risks) == (0, 0.99, "high", [])


def test_conflict_margin(spark):
    rows = spark.createDataFrame([
        ("near", "a", 0, "x", 0.98, "e", []), ("near", "a", 1, "y", 0.93, "e", []),
        ("far", "a", 0, "x", 0.99, "e", []), ("far", "a", 1, "y", 0.94, "e", []),
        ("low", "a", 0, "x", 0.84, " ", []), ("low", "a", 1, "y", 0.84, "e", ["low_confidence_ocr"])], SCHEMA)
    got = {r.unit_id: r for r in C.resolve(C.upsert(rows)).collect()}
    assert got["near"].conflict and "conflict" in got["near"].risks
    assert not got["far"].conflict
    assert not got["low"].conflict and got["low"].value == "x" and got["low"].risks == ["missing_evidence"]


def test_badly_read_spans_taint_candidates(spark):
    rows = spark.createDataFrame([
        ("u", "a", 0, "1234.50", 0.9, "x", []), ("u", "b", 1, "甲公司", 0.9, "甲公司 地址", []), ("u", "c", 2, "safe", 0.9, "y", [])], SCHEMA)
    spans = spark.createDataFrame([("u", "1,234.50", 0.4), ("u", "甲公司 地址", 0.3), ("u", "safe", 0.9)], "unit_id string, text string, confidence double")
    got = {r.field: r.risks for r in C.low_confidence_risks(rows, spans).collect()}
    assert got == {"a": ["low_confidence_ocr"], "b": ["low_confidence_ocr"], "c": []}


def test_header_is_wide_and_typed(spark):
    rows = spark.createDataFrame([("u", "total_with_tax", 0, "1,000.5", 0.9, "e", []), ("u", "invoice_date", 1, "2024-01-05", 0.9, "e", [])], SCHEMA)
    header = C.header_fields(C.resolve(C.upsert(rows))).first()
    assert str(header.total_with_tax) == "1000.50" and header.invoice_date == "2024-01-05" and header.invoice_no is None
    assert set(C.HEADER_FIELDS) <= set(header.asDict())
    assert C.unit_confidence(rows).select(F.col("confidence")).first()[0] == 0.9
