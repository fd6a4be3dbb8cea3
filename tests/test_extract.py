"""Whole documents through the pipeline, with one custom type, check and split."""

import pytest
from pyspark.sql import functions as F

from voucherlake.operators import extract as E
from voucherlake.operators import items as I
from voucherlake.operators import routing, tickets
from voucherlake.plans import pipeline
from voucherlake.rules.tables import shipped

DOCS = {
    "untaxed": ["电子发票（普通发票）", "发票号码：00000000000000000001", "开票日期：2026年07月26日", "购买方名称：甲方测试公司",
                "购买方 统一社会信用代码 TESTBUYER000000001", "销售方名称：乙方测试公司", "销售方 统一社会信用代码 TESTSELLER00000001",
                "*服务*测试 次 1 100.00 100.00 不征税", "价税合计（小写）¥100.00"],
    "star": ["电子发票（普通发票）", "发票号码：00000000000000000002", "开票日期：2026年07月26日", "*服务*测试", "次", "1", "100.00", "100.00", "*", "*",
             "合 计 ¥100.00 ¥0.00", "价税合计（小写）¥100.00"],
    "order": ["电子发票（普通发票）", "发票号码：00000000000000000003", "开票日期：2026年07月26日", "甲乙丙公司", "TESTBUYER000000001", "丁戊己公司", "TESTSELLER00000001",
              "价税合计（小写）¥100.00"],
    "unknown": ["普通文本"],
}


@pytest.fixture(scope="module")
def outcome(spark):
    df = spark.createDataFrame(list(DOCS.items()), "unit_id string, lines array<string>")
    rules = {"standard-invoice": shipped()["standard-invoice"]}
    return pipeline.process(df, "run", "2026-07-26T10:00:00", rules)


def test_records(outcome):
    got = {r.unit_id: r for r in outcome.records.invoices.collect()}
    one = got["untaxed"]
    assert (one.status, str(one.amount_total), str(one.tax_total), str(one.total_with_tax)) == ("ready", "100.00", "0.00", "100.00")
    assert (one.buyer_name, one.seller_name, one.buyer_tax_id, one.seller_tax_id) == ("甲方测试公司", "乙方测试公司", "TESTBUYER000000001", "TESTSELLER00000001")
    assert got["unknown"].status == "unmodeled"
    assert "uncertain party role buyer_tax_id" in got["order"].remark and "missing items" in got["order"].remark
    assert (got["order"].buyer_name, got["order"].seller_name) == ("甲乙丙公司", "丁戊己公司")


def test_lines(outcome):
    got = {r.unit_id: r for r in outcome.records.lines.collect()}
    assert (got["untaxed"].tax_rate, got["untaxed"].line_tax_amount) == ("不征税", None)
    assert (got["star"].tax_rate, str(got["star"].line_tax_amount), str(got["star"].line_total_with_tax)) == ("*", "0.00", "100.00")


def test_rows_and_notices(outcome):
    rows = {r.unit_id: r for r in outcome.rows.collect()}
    assert set(rows) == {"untaxed", "star", "order"}
    assert rows["order"].line_no == 1 and rows["order"].recognition_status == "review_required"
    told = {r.unit_id: r for r in outcome.notices.collect()}
    assert told["unknown"].issue_type == "暂不支持此票种"
    assert told["order"].severity == "需复核"
    assert outcome.notices.groupBy("unit_id").count().filter("count > 1").count() == 0


def test_a_batch_is_appended_once(spark, outcome, tmp_path):
    path = str(tmp_path / "ledger")
    pipeline.append_outcome(outcome, path, "run")
    pipeline.append_outcome(outcome, path, "run")
    rows = spark.read.parquet(f"{path}/rows")
    assert rows.count() == 3 and sorted(r.row_sequence for r in rows.collect()) == [1, 2, 3]
    told = spark.read.parquet(f"{path}/notices")
    assert told.count() == told.select("notice_id").distinct().count()
    assert told.filter("issue_type = '疑似重复'").count() == 3
    counters = spark.read.json(f"{path}/run_summary").orderBy("added_rows").collect()
    assert [(r.added_rows, r.skipped_rows, r.unmodeled_units) for r in counters] == [(0, 3, 1), (3, 0, 1)]
    assert spark.read.json(f"{path}/evidence").filter("unit_id = 'order' and part = 'issues'").count() > 0


def test_a_type_can_be_added(spark):
    rules = {"note": {"schema_id": "note", "match_rules": {"required_all": ["送货单"]}}}

    def note(d, rule):
        return [tickets._c("invoice_no", F.regexp_extract(d.text, "编号([0-9]+)", 1), 0.9, "note")], I.no_items()

    df = spark.createDataFrame([("n", ["送货单", "编号77"])], "unit_id string, lines array<string>")
    got = E.extract(routing.route(df, rules, None), rules, {"note": note}).first()
    assert [(c.field, c.value) for c in got.found] == [("invoice_no", "77")]
