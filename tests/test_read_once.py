"""What is written between the texts and the records."""

import datetime
import glob

import pytest
from voucherlake.plans import document_queries as Q

ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    rows = [(i, i % 3, "F", 100.0 + i, datetime.date(1995, 1, 2), p) for i, p in enumerate(Q.PRIORITIES * 2)]
    spark.createDataFrame(rows, ORDER).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr("voucherlake.session.shared_folder", lambda spark: f"{tmp_path}/kept")
    return str(tmp_path)


def written(spark, folder):
    return sorted(c for path in glob.glob(f"{folder}/kept/*") for c in spark.read.parquet(path).columns)


def test_lines_are_written_without_candidates(spark, folder):
    found = Q.sequence_items(spark, folder)
    assert written(spark, folder) == ["items", "schema_id", "unit_id", "variant_id"]
    assert sorted((r.unit_id, r.line_no, str(r.line_amount)) for r in found.collect()) == [(i, 1, f"{100 + i}.00") for i in range(10)]


def test_headers_are_written_without_lines(spark, folder):
    found = Q.invoice_headers(spark, folder)
    assert written(spark, folder) == ["found", "unit_id"]
    assert sorted((r.unit_id, r.invoice_no, str(r.amount_total)) for r in found.collect()) == [(i, f"{i:020d}", f"{100 + i}.00") for i in range(10)]
