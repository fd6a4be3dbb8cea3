"""Batches that fail at any place and are run again, against one clean run."""

import json

import pytest
from pyspark.sql import functions as F

from voucherlake.operators import dedup, notices
from voucherlake.plans import source_queries
from voucherlake.sources import commits, sinks

ORDER = source_queries.EVENT_ORDER


def batches(spark):
    events = spark.sql("select id event_id, id % 5 user_id, 'view' event_type, cast(id % 7 as double) value from range(40)")
    return [source_queries.event_rows(events.filter(f"event_id % 2 <= {n}")) for n in range(2)]


def append(spark, path, number, batch):
    invoices = batch.select("unit_id", F.lit("review_required").alias("status"))

    def evidence(name):
        rows = batch.select("unit_id", F.lit("ready").alias("recognition_status"), F.lit("").alias("review_remark"))
        sinks.write_evidence("run", path, rows, invoices, name, lines=batch.select("unit_id", "line_no"))

    return sinks.append_batch(
        batch, path, ORDER, f"run/{number}", "run", lambda judged: notices.duplicate_notices(judged, ORDER), evidence)


def tables(spark, path):
    told = {t: sorted(map(str, commits.read(spark, path, t).collect())) for t in ("rows", "keys", "notices", "judged")}
    return told | {"evidence": sorted(map(str, commits.read(spark, path, "evidence", form="json").collect()))}


@pytest.fixture(scope="module")
def clean(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clean"))
    for number, batch in enumerate(batches(spark)):
        append(spark, path, number, batch)
    return tables(spark, path)


@pytest.mark.parametrize("place", ["rows", "notices", "evidence", "marker"])
def test_failures_leave_no_trace(spark, clean, tmp_path, monkeypatch, place):
    """The write named fails after it is done, in every batch, and the batch is run again; then all are run once more."""
    path, write, commit, failed = str(tmp_path), commits.write, commits.commit, set()

    def failing(name, batch_id):
        if name == place and batch_id not in failed:
            failed.add(batch_id)
            raise InterruptedError(name)

    def broken_write(df, path, table, batch_id, *rest, **options):
        write(df, path, table, batch_id, *rest, **options)
        failing(table, batch_id)

    def broken_commit(spark, path, batch_id, *rest):
        commit(spark, path, batch_id, *rest)
        failing("marker", batch_id)

    monkeypatch.setattr(commits, "write", broken_write)
    monkeypatch.setattr(commits, "commit", broken_commit)
    for number, batch in enumerate(batches(spark)):
        with pytest.raises(InterruptedError):
            append(spark, path, number, batch)
        append(spark, path, number, batch)
    assert len(failed) == 2 and tables(spark, path) == clean
    again = append(spark, path, 0, batches(spark)[0])
    assert {r.action for r in again.collect()} == {"added"} and tables(spark, path) == clean


def test_rows_are_numbered_on_and_keys_replace_a_scan_of_the_rows(spark, tmp_path):
    path = str(tmp_path)
    for number, batch in enumerate(batches(spark)):
        append(spark, path, number, batch)
        rows = commits.read(spark, path, "rows")
        assert sorted(r.row_sequence for r in rows.collect()) == list(range(1, rows.count() + 1)) and commits.last_row(spark, path) == rows.count()
    kept = dedup.with_fingerprint(sinks.ledger_fingerprint_columns(batches(spark)[1]))
    found = sinks.known_keys(kept, path)
    scans = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Location" in line or "FileScan" in line]
    assert any("/keys" in s for s in scans) and not any("/rows" in s for s in scans)
    whole = dedup.ledger_keys(commits.read(spark, path, "rows"))
    asked = dedup.identity_keys(kept)
    want = {tuple(r) for r in whole.join(asked, ["kind", "key"], "left_semi").collect()}
    assert {tuple(r) for r in found.collect()} == want and want


def test_a_batch_that_breaks_the_contract_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    with pytest.raises(ValueError, match="missing_required_field"):
        sinks.append_batch(batches(spark)[0], path, ORDER, "b", contract=True)
    assert not commits.exists(spark, path)
    short = {"detail": {"name": "t", "fields": [("invoice_no", "no", True, None), ("item_name", "no", True, None)]}}
    with pytest.raises(ValueError, match="duplicate_header no"):
        sinks.require_contract(batches(spark)[0], short)


def test_names_that_need_escaping(spark, tmp_path):
    name = "run 1/é=%:7"
    sinks.append_batch(batches(spark)[0], str(tmp_path), ORDER, name)
    assert {r.batch_id for r in commits.read(spark, str(tmp_path), "rows").collect()} == {name}
    assert json.dumps(sorted(p.name for p in tmp_path.iterdir() if p.is_dir())) == '["commits", "judged", "keys", "rows"]'
