"""Nothing is cut: long remarks, evidences and names, high line numbers, deep inheritance, failed inputs."""

import pytest
from pyspark.sql import functions as F

from voucherlake.operators import candidates, checks, vat
from voucherlake.plans import pipeline
from voucherlake.rules.tables import cycles, effective_rules, inheritance_closure, rule_rows


def test_remarks_quote_all_issues(spark):
    issues = spark.range(2500).select(F.lit("u").alias("unit_id"), F.col("id").alias("seq"), F.concat(F.lit("i"), "id").alias("text"))
    one = checks.issue_remarks(issues).first()
    assert one.n_issues == 2500 and one.issue_remark == "; ".join(f"i{n}" for n in range(2500))


def test_evidence_and_negative_names_of_all_lines(spark):
    lines = spark.range(1, 2501).select(
        F.lit("u").alias("unit_id"), F.col("id").cast("int").alias("line_no"), F.lit(0.9).alias("confidence"), F.concat(F.lit("e"), "id").alias("evidence"),
        F.array().cast("array<string>").alias("risks"), F.concat(F.lit("n"), "id").alias("item_name"), F.lit(-1).cast("decimal(18,2)").alias("line_amount"),
        F.lit(None).cast("decimal(18,2)").alias("line_tax_amount"), F.lit(-1).cast("decimal(18,2)").alias("line_total_with_tax"))
    assert candidates.items_decision(lines).first().evidence.split("; ")[-1] == "e2500"
    assert vat.negative_gate(lines).first().negative_names.split("、") == [f"n{i}" for i in range(1, 2501)]


def test_checks_keep_their_order_above_a_hundred_thousand_lines(spark):
    money = "decimal(18,2)"
    invoices = spark.sql("select 'u' unit_id, 's' schema_id, null variant_id").selectExpr(
        "*", *[f"cast(1 as {money}) {n}" for n in ("amount_total", "tax_total", "total_with_tax")])
    lines = spark.sql(f"""select 'u' unit_id, id line_no, cast(1 as {money}) line_amount, cast(1 as {money}) line_tax_amount,
        cast(9 as {money}) line_total_with_tax, cast(5 as {money}) quantity, cast(5 as {money}) unit_price from values (150000L), (3L) t(id)""")
    found = checks.amount_checks(invoices, lines, {"s": list(checks.AMOUNT_CHECKS)}).orderBy("seq").collect()
    said = [r.text.split(": ")[1] for r in found if r.text.startswith("line ")]
    assert len(said) == 4 and said[0] == said[1] != said[2] == said[3]


def test_twelve_generations_and_a_cycle(spark):
    documents = [{"schema_id": f"d{i}", "extends": f"d{i + 1}" if i < 12 else None, f"own{i}": i} for i in range(13)]
    rows = {(r.schema_id, r.path): r.depth for r in effective_rules(rule_rows(spark, documents)).collect()}
    assert rows[("d0", "own12")] == 12
    documents[12]["extends"] = "d0"
    looped = rule_rows(spark, documents)
    assert {r.schema_id for r in cycles(inheritance_closure(looped)).collect()} == {f"d{i}" for i in range(13)}
    with pytest.raises(ValueError, match="cycle"):
        effective_rules(looped)


def test_failed_inputs_stay_failed(spark):
    docs = spark.createDataFrame([("e", "f.txt", [1], "text_file", [], "failed", "empty")],
                                 "unit_id string, source_file string, page_range array<int>, source string, lines array<string>, status string, remark string")
    outcome = pipeline.process(docs, "r", "2024-05-31T18:00:00")
    one = outcome.records.invoices.first()
    assert (one.status, one.remark) == ("failed", "empty")
    assert outcome.rows.count() == 0 and outcome.notices.count() == 1
