"""No registered query may fall back to a nested-loop or cartesian join on tables."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PLANNED = ["ledger_rows", "validation_status", "vat_split_lines", "invoice_rollup", "notices", "candidate_resolve", "merge_pages", "table_items", "select_route"]


@pytest.mark.parametrize("name", PLANNED)
def test_joins_are_equi_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scans_read_only_what_they_need(spark):
    plan = entry.queries()["invoice_rollup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in plan.split("ReadSchema")[1] and "l_shipdate" not in plan.split("ReadSchema")[1]


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
