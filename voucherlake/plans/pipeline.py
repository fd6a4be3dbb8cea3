"""From documents to an appended ledger: route, extract, resolve, split VAT, check, build rows, notify.

Documents are one row each, so everything up to the candidates is a projection. The first
shuffle is on unit_id, over candidates and lines, not over texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlake.operators import candidates as C
from voucherlake.operators import checks, ledger, notices, placed, reports, vat
from voucherlake.operators.extract import extract, item_rows
from voucherlake.operators.routing import route
from voucherlake.rules.catalog import VAT_RULES
from voucherlake.rules.tables import required_fields, shipped
from voucherlake.session import keyed, staged
from voucherlake.sources import sinks

UNMODELED_REMARK = "未匹配当前已建模票种。"
RESOLVED_REMARK = "字段候选已决策，尚未通过字段校验。"


@dataclass(frozen=True)
class Records:
    """Headers (one row per unit), lines, and the decisions behind them; structured records have none."""

    invoices: DataFrame
    lines: DataFrame
    decisions: DataFrame | None = None


@dataclass(frozen=True)
class Outcome:
    records: Records
    issues: DataFrame
    rows: DataFrame
    notices: DataFrame


def recognise(docs: DataFrame, rules: dict[str, dict] | None = None, keep: bool = True) -> DataFrame:
    """Route and extract. Only ids, candidates and lines go on; with `keep` they are written once,
    since candidates and lines are read separately."""
    rules = rules or shipped()
    routed = route(docs, rules, "standard-invoice" if "standard-invoice" in rules else None)
    carried = [F.col(c) for c in ("unit_id", "source_file", "page_range", "source") if c in docs.columns]
    carried += [
        (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(f"input_{c}") for c in ("status", "remark")]
    extracted = extract(routed, rules).select(
        *carried, "schema_id", "variant_id", "route_confidence", "decision", "route_reason", "found", "items", "context")
    return staged(extracted, "extracted") if keep else extracted


def records(extracted: DataFrame, by_place: placed.Placed | None = None) -> Records:
    """Resolve candidates to headers; a document that matched nothing is unmodeled.

    by_place: what the boxes of the documents tell; its candidates join the others, its lines compete with theirs.
    """
    read = C.long_candidates(extracted, "found")
    found, lines = C.upsert(read if by_place is None else read.unionByName(by_place.candidates)), item_rows(extracted)
    if by_place is not None:
        found = C.low_confidence_risks(found, by_place.read)
        lines = staged(placed.chosen_lines(lines, by_place, read, extracted.select("unit_id", "context")), "chosen")
    decisions = C.resolve(found)
    header = C.header_fields(decisions)
    line_scores = lines.select("unit_id", "confidence")
    scores = found.select("unit_id", "confidence").unionByName(line_scores)
    header = header.join(keyed(C.unit_confidence(scores)), "unit_id", "left")
    base = extracted.select(
        "unit_id",
        F.col("source_file") if "source_file" in extracted.columns else F.col("unit_id").alias("source_file"),
        F.col("page_range") if "page_range" in extracted.columns else F.array(F.lit(1)).alias("page_range"),
        "schema_id", "variant_id", "decision", "route_confidence", "input_status", "input_remark")
    failed = F.coalesce(F.col("input_status") == "failed", F.lit(False))
    matched = F.col("decision") == "matched"
    joined = base.join(keyed(header), "unit_id", "left").withColumn(
        "status", F.when(failed, F.lit("failed")).when(matched, F.lit("review_required")).otherwise(F.lit("unmodeled"))).withColumn(
        "remark", F.when(failed, F.col("input_remark")).when(matched, F.lit(RESOLVED_REMARK)).otherwise(F.lit(UNMODELED_REMARK))).withColumn(
        "confidence", F.when(failed, F.lit(0.0)).when(matched, F.coalesce("confidence", F.lit(0.0))).otherwise(F.col("route_confidence"))).drop("input_status", "input_remark")
    with_items = decisions.unionByName(C.items_decision(lines).withColumn("n_conflicts", F.lit(0).cast("bigint")))
    return Records(joined, vat.link_discounts(lines, ["line_no"]), with_items)


def check(recs: Records, rules: dict[str, dict] | None = None, structured: bool = False) -> tuple[DataFrame, DataFrame]:
    """All checks of the documents' types; returns (validated invoices, issue table)."""
    rules = rules or shipped()
    invoices, lines = recs.invoices.filter("status not in ('unmodeled', 'failed')"), recs.lines
    enabled = {name: rule.get("amount_checks", []) for name, rule in rules.items()}
    family = [n for n, r in rules.items() if n == "standard-invoice" or r.get("extends") == "standard-invoice"]
    with_lines = [n for n, r in rules.items() if r.get("line_table", {}).get("required")]
    required = required_fields(rules)
    issues = checks.prior_issues(invoices).unionByName(checks.missing_required(invoices, lines, required))
    if not structured:
        present = checks.present_fields(invoices, lines)
        proven = F.col("schema_id").isin(*checks.proven_schemas(rules)) if checks.proven_schemas(rules) else F.lit(False)
        line_fields = [c for c in lines.columns if c != "unit_id"]
        issues = issues.unionByName(checks.field_evidence(present, recs.decisions, checks.required_list(required), proven, line_fields))
    issues = (
        issues.unionByName(checks.variant_issues(invoices, family)).unionByName(checks.party_issues(invoices))
        .unionByName(checks.missing_items(invoices.filter(F.col("schema_id").isin(with_lines)), lines))
        .unionByName(checks.amount_checks(invoices, lines, enabled)))
    return checks.validate(recs.invoices, issues), issues


def _pair(recs: Records) -> tuple[DataFrame, DataFrame]:
    return recs.invoices, recs.lines


def _kept(recs: Records, keep: bool) -> Records:
    """Headers, lines and decisions are read by many checks; they are written once in between."""
    if not keep:
        return recs
    decisions = staged(recs.decisions, "decisions") if recs.decisions is not None else None
    return Records(staged(recs.invoices, "invoices"), staged(recs.lines, "lines"), decisions)


def process(docs: DataFrame, run_id: str, processed_at: str, rules: dict[str, dict] | None = None,
            vat_rules: list[dict] | None = None, keep: bool = True) -> Outcome:
    """Documents to ledger rows and notices. Documents with `spans` are also read by the places of their texts."""
    rules = rules or shipped()
    extracted = recognise(docs, rules, keep)
    by_place = placed.read(docs, extracted, rules) if "spans" in docs.columns else None
    recs = _kept(records(extracted, by_place), keep)
    applicable = [r for r in (VAT_RULES if vat_rules is None else vat_rules) if set(r["schema_ids"]) & set(rules)]
    if applicable:
        invoices, lines = vat.apply_vat_rules(recs.invoices, recs.lines, applicable, ["line_no"])
        split = Records(invoices.drop("vat_action"), lines)
        recs = Records(*_pair(_kept(split, keep)), recs.decisions)
    validated, issues = check(recs, rules)
    validated = staged(validated, "validated") if keep else validated
    rows = ledger.ledger_rows(validated, recs.lines, run_id, processed_at)
    units = validated.select(
        "unit_id", "source_file", "page_range", F.when(F.col("status") == "failed", "failed").otherwise("ready").alias("unit_status"), F.col("status").alias("record_status"),
        "invoice_no", "total_with_tax")
    told = notices.build_notices(rows, units, ["line_no"])
    return Outcome(Records(validated, recs.lines, recs.decisions), issues, rows, told)


def summary(outcome: Outcome, added: DataFrame | None = None) -> DataFrame:
    units = outcome.records.invoices.select("unit_id", "source_file", F.col("status").alias("record_status"))
    return reports.run_summary(outcome.rows, units, added)


def append_outcome(outcome: Outcome, path: str, run_id: str, spread: int = 1 << 40, batch_id: str | None = None) -> DataFrame:
    """Write a processed batch: ledger rows, notices (also of repeated rows), evidence and counters.

    Documents are spread over `spread` positions by a hash of their id, which fixes the order of
    the row numbers. Returns what happened to every identity of the batch. A batch with a name may be written
    again after a failure at any place: it counts once. Rows that do not meet the output contract are refused.
    """
    order = ["doc", "line_no", "invoice_line_key"]
    rows = outcome.rows.withColumn("doc", F.pmod(F.xxhash64("unit_id"), F.lit(spread)))
    name = batch_id or uuid.uuid4().hex

    def told(judged: DataFrame) -> DataFrame:
        return outcome.notices.unionByName(notices.duplicate_notices(judged, order))

    def evidence(batch: str) -> None:
        sinks.write_evidence(run_id, path, outcome.rows, outcome.records.invoices, batch, lines=outcome.records.lines,
                             decisions=outcome.records.decisions, issues=outcome.issues)

    judged = sinks.append_batch(rows, path, order, name, run_id, told, evidence, contract=True)
    sinks.write_run_summary(summary(outcome, judged), run_id, path, name)
    return judged
