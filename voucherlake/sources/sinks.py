"""Append-only sinks: ledger rows, their keys, notices, evidence, run artefacts, written batch by batch under a commit log.

A batch has a name. It is judged against what was committed before it, so an attempt after a failure gives the same rows,
numbers, notices and evidence as a clean one; a batch that is run again after its commit gives what it wrote and writes nothing.
Existing rows are found through a table of keys that grows with the ledger, not by reading the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlake.operators import dedup, ledger, notices, reports
from voucherlake.session import keyed, staged
from voucherlake.sources import commits

#: Key files are parted by a hash of the key, sorted and with Bloom filters, so that a lookup reads what may hold its keys.
KEY_BUCKETS = 16
BLOOM = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": "200000"}
KEY_SCHEMA = "kind int, key string, first_row long, last_row long, bucket int"


def _bucket() -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(KEY_BUCKETS)).cast("int")


def known_keys(batch: DataFrame, path: str) -> DataFrame:
    """(kind, key, existing_row) of the committed ledger rows that share a key with the batch.

    Only the key table is read: buckets that the batch has no key of are pruned, files by their Bloom filters.
    """
    spark = batch.sparkSession
    nothing = spark.createDataFrame([], KEY_SCHEMA)
    if not commits.exists(spark, f"{path}/keys"):
        return dedup.merged_keys(nothing)
    asked = dedup.identity_keys(batch).withColumn("bucket", _bucket())
    stored = commits.read(spark, path, "keys", nothing)
    hit = stored.join(asked, ["bucket", "kind", "key"], "left_semi")
    return dedup.merged_keys(hit)


def _write_keys(numbered: DataFrame, path: str, batch_id: str) -> None:
    keys = dedup.row_keys(numbered).withColumn("bucket", _bucket())
    keys = keys.repartition(KEY_BUCKETS, "bucket").sortWithinPartitions("bucket", "kind", "key")
    commits.write(keys, path, "keys", batch_id, ("bucket",), **BLOOM)


DETAIL = {"detail": ledger.OUTPUT_PROFILE["detail"]}


def require_contract(rows: DataFrame, profile: dict = DETAIL) -> None:
    """Refuse a batch whose output lacks a table, a required column, or has one twice; nothing has been written then.

    The headers checked are those the rows would be printed under. Row numbers, 20-digit numbers and remarks are made on the way.
    """
    spark = rows.sparkSession
    given = {*rows.columns, "row_sequence", "digital_invoice_no", "remark"}
    headers = [(spec["name"], header) for spec in profile.values() for name, header, _, source in spec["fields"] if (source or name) in given]
    found = reports.contract_check(spark.createDataFrame(headers, "table_name string, header string"), reports.profile_table(spark, profile))
    blocking = found.filter("blocks").orderBy("table_key", "violation", "subject").collect()
    if blocking:
        told = "; ".join(f"{r.table_key}: {r.violation} {r.subject}".strip() for r in blocking)
        raise ValueError(f"the output contract is not met: {told}")


def append_batch(
    batch: DataFrame, path: str, order: list[str], batch_id: str, run_id: str = "",
    told: Callable[[DataFrame], DataFrame] | None = None, evidence: Callable[[str], None] | None = None,
    contract: bool = False,
) -> DataFrame:
    """Append a named batch: ledger rows, their keys, notices and evidence, and then the marker that makes them count.

    Returns what happened to every identity of the batch; the same when it is called again, whether the first call failed
    at any place or not. `told` gives the notices of the judged batch, `evidence` writes into the folder of the name it
    is given. With `contract` a batch that does not meet the output contract is refused before anything is written.
    `order` starts with two numeric positions: document and line.
    """
    spark = batch.sparkSession
    if commits.is_committed(spark, path, batch_id):
        return commits.read(spark, path, "judged").filter(F.col(commits.BATCH) == batch_id).drop(commits.BATCH)
    if contract:
        require_contract(batch)
    kept = staged(dedup.with_fingerprint(ledger_fingerprint_columns(batch)), "batch")
    keys = staged(known_keys(kept, path), "known")
    judged = commits.written(dedup.dedup(kept, keys, order, [c for c in dedup.CARRIED if c in kept.columns]), path, "judged", batch_id)
    before = commits.last_row(spark, path)
    fresh = staged(dedup.new_rows(kept, keys, order, judged), "fresh")
    numbered = ledger.number_rows(fresh, order, before).withColumn("row_sequence", F.col("row_sequence").cast("bigint"))
    numbered = commits.written(numbered.select(*kept.columns, "row_sequence"), path, "rows", batch_id, ("run_id",) if "run_id" in kept.columns else ())
    _write_keys(numbered, path, batch_id)
    if told is not None:
        _write_notices(told(judged), path, batch_id)
    if evidence is not None:
        evidence(batch_id)
    last, added = numbered.agg(F.max("row_sequence"), F.count(F.lit(1))).first()
    commits.commit(spark, path, batch_id, run_id, last or before, added)
    return judged


def append_ledger(batch: DataFrame, path: str, order: list[str], replace_existing: bool = False,
                  update_existing: bool = False, batch_id: str | None = None) -> DataFrame:
    """Append the rows a ledger does not hold yet; returns what happened to every identity of the batch.

    Without a name the batch gets a new one. Keys come from the content of a row, so a repeated batch adds nothing.
    """
    if replace_existing or update_existing:
        raise ValueError("the ledger is append-only: rows are neither replaced nor updated")
    return append_batch(batch, path, order, batch_id or uuid.uuid4().hex)


def ledger_fingerprint_columns(batch: DataFrame) -> DataFrame:
    """A batch carries the printed 20-digit number in a column of its own, as the ledger prints it."""
    if "digital_invoice_no" in batch.columns:
        return batch
    digital = F.coalesce(F.trim("invoice_no").rlike("^[0-9]{20}$"), F.lit(False))
    return batch.withColumn("digital_invoice_no", F.when(digital, F.col("invoice_no")))


def _write_notices(found: DataFrame, path: str, batch_id: str) -> DataFrame:
    existing = commits.read(found.sparkSession, path, "notices", found)
    fresh = staged(notices.fresh_notices(found, existing.select(found.columns)), "notices")
    commits.write(fresh, path, "notices", batch_id)
    return fresh


def append_notices(found: DataFrame, path: str, batch_id: str | None = None) -> DataFrame:
    """Append notices whose id is not there yet as a batch of their own; returns the appended ones."""
    spark, name = found.sparkSession, batch_id or uuid.uuid4().hex
    if commits.is_committed(spark, path, name):
        return commits.read(spark, path, "notices", found).filter(F.col(commits.BATCH) == name).select(found.columns)
    fresh = _write_notices(found, path, name)
    commits.commit(spark, path, name, "", commits.last_row(spark, path), 0)
    return fresh


def units_with_evidence(rows: DataFrame, invoices: DataFrame) -> DataFrame:
    """Units that are not ready, or have a row that is not ready or carries a review remark."""
    from_rows = notices.issue_rows(rows).select("unit_id")
    from_records = invoices.filter("status <> 'ready'").select("unit_id")
    return from_rows.unionByName(from_records).distinct()


def write_evidence(run_id: str, path: str, rows: DataFrame, invoices: DataFrame, batch_id: str | None = None, **parts: DataFrame) -> None:
    """Evidence of doubtful units as JSON rows (unit, part, payload), one file set per part.

    A part is any table with unit_id: candidates, decisions, lines, texts. Rows stay rows, so a unit
    of any size is written by many tasks. An attempt of the same batch replaces what the one before wrote.
    """
    units = staged(units_with_evidence(rows, invoices), "doubtful")
    told = None
    for name, part in {"ledger_rows": rows, "invoice_record": invoices, **parts}.items():
        payload = F.to_json(F.struct(*[F.col(c) for c in part.columns if c != "unit_id"]))
        kept = part.join(keyed(units), "unit_id", "left_semi").select(
            F.col("unit_id").cast("string").alias("unit_id"), payload.alias("payload"), F.lit(run_id).alias("run_id"), F.lit(name).alias("part"))
        told = kept if told is None else told.unionByName(kept)
    commits.write(told, path, "evidence", batch_id or uuid.uuid4().hex, ("run_id", "part"), "json")


def write_run_summary(summary: DataFrame, run_id: str, path: str, batch_id: str | None = None) -> None:
    commits.write(summary.withColumn("run_id", F.lit(run_id)), path, "run_summary", batch_id or uuid.uuid4().hex, ("run_id",), "json")
