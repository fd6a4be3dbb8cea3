"""Candidate values: upsert, ranked resolution with conflicts, confidence and risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlake.functions.money import MONEY, compact_number
from voucherlake.functions.text import let
from voucherlake.session import keyed

CONFLICT_FLOOR = 0.85
CONFLICT_DELTA = 0.05
LOW_SPAN = 0.6

HEADER_FIELDS = (
    "invoice_code", "invoice_no", "invoice_date", "buyer_name", "buyer_tax_id", "seller_name", "seller_tax_id",
    "invoice_type", "special_invoice_type", "is_red_invoice", "red_original_no", "red_original_code", "red_confirm_no",
    "amount_total", "tax_total", "total_with_tax",
)
MONEY_FIELDS = ("amount_total", "tax_total", "total_with_tax")

CANDIDATE = "struct<field:string,value:string,confidence:double,evidence:string,risks:array<string>>"


def candidate(field: str, value: Column, confidence, evidence: Column, risks: list[str] | None = None) -> Column:
    """One candidate as a struct; a null or empty value is no candidate."""
    level = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    risk = F.array(*[F.lit(r) for r in risks]) if risks else F.array().cast("array<string>")
    return let(value, lambda v: F.when(v.isNotNull() & (v != ""), F.struct(
        F.lit(field).alias("field"), v.cast("string").alias("value"), level.cast("double").alias("confidence"),
        F.coalesce(evidence, F.lit("")).alias("evidence"), risk.alias("risks"))))


def long_candidates(docs: DataFrame, column: str, *carry: str) -> DataFrame:
    """Explode an array of candidate structs to rows; pos is the order of insertion."""
    return docs.select("unit_id", *carry, F.posexplode(F.filter(column, lambda c: c.isNotNull())).alias("pos", "_c")).select(
        "unit_id", *carry, "pos", "_c.*")


def upsert(candidates: DataFrame) -> DataFrame:
    """One row per (unit, field, value): the first keeps its place, a strictly higher confidence its evidence."""
    best = F.struct("confidence", "evidence", "risks")
    return candidates.groupBy("unit_id", "field", "value").agg(
        F.min("pos").alias("pos"), F.max_by(best, F.struct("confidence", -F.col("pos"))).alias("_best")
    ).select("unit_id", "field", "value", "pos", "_best.*")


def resolve(candidates: DataFrame) -> DataFrame:
    """One decision per (unit, field): highest confidence, ties to the earliest.

    A conflict is another value of nearly the same high confidence. Input is upserted.
    """
    value = F.struct("value", "confidence", "evidence", "risks")
    # Conflicting values are those of high confidence near the best; how near is known once the best is.
    strong = F.col("confidence") >= CONFLICT_FLOOR
    grouped = candidates.groupBy("unit_id", "field").agg(
        F.max_by(value, F.struct("confidence", -F.col("pos"))).alias("_best"),
        F.count(F.lit(1)).alias("candidate_count"),
        F.avg("confidence").alias("_mean"),
        F.count_if(strong).alias("_strong"),
    )
    near = conflicts(candidates).groupBy("unit_id", "field").agg(F.count(F.lit(1)).alias("n_conflicts"))
    joined = grouped.join(keyed(near), ["unit_id", "field"], "left").select(
        "unit_id", "field", "_best.*", "candidate_count", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"))
    return joined.withColumn("conflict", F.col("n_conflicts") > 0).withColumn("risks", _risks())


def _risks() -> Column:
    risks = F.col("risks")
    extra = F.array(
        F.when(F.col("conflict"), F.lit("conflict")),
        F.when(F.trim("evidence") == "", F.lit("missing_evidence")),
        F.when(F.exists(risks, lambda r: r.startswith("low_confidence")), F.lit("low_confidence")),
    )
    return F.array_distinct(F.concat(risks, F.filter(extra, lambda r: r.isNotNull())))


def conflicts(candidates: DataFrame) -> DataFrame:
    """(unit, field, value) of values that contradict the chosen one; whole, one row each."""
    strong = candidates.filter(F.col("confidence") >= CONFLICT_FLOOR)
    best = strong.groupBy("unit_id", "field").agg(
        F.max_by(F.struct("value", "confidence"), F.struct("confidence", -F.col("pos"))).alias("_best"))
    joined = strong.join(keyed(best), ["unit_id", "field"])
    near = F.abs(F.col("_best.confidence") - F.col("confidence")) <= CONFLICT_DELTA
    return joined.filter(near & (F.col("value") != F.col("_best.value"))).select("unit_id", "field", "value", "confidence")


def unit_confidence(candidates: DataFrame) -> DataFrame:
    """Mean confidence over all candidates of a unit, four digits, half to even."""
    return candidates.groupBy("unit_id").agg(F.bround(F.avg("confidence"), 4).alias("confidence"))


def header_fields(decisions: DataFrame, names=HEADER_FIELDS) -> DataFrame:
    """Decisions as one wide row per unit; the field list is fixed, so no extra job looks for it."""
    wide = decisions.groupBy("unit_id").agg(*[
        F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])
    for name in names:
        if name in MONEY_FIELDS:
            wide = wide.withColumn(name, F.round(compact_number(F.col(name)).try_cast("decimal(28,12)"), 2).try_cast(MONEY))
        elif name == "invoice_date":
            wide = wide.withColumn(name, F.col(name).try_cast("date").cast("string"))
    return wide


def items_decision(items: DataFrame) -> DataFrame:
    """Decision for the lines of a unit: lowest confidence, distinct risks, evidences of all lines in their order."""
    numbers = items.groupBy("unit_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.min("confidence").alias("confidence"))
    risk_rows = items.select("unit_id", "line_no", F.explode("risks").alias("risk")).groupBy("unit_id", "risk").agg(
        F.min("line_no").alias("_at"))
    risks = risk_rows.groupBy("unit_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "risk"))), lambda s: s["risk"]).alias("risks"))
    quoted = items.filter(F.trim("evidence") != "")
    texts = quoted.groupBy("unit_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("line_no", "evidence"))), lambda s: s["evidence"]), "; ").alias("evidence"))
    none = F.array().cast("array<string>")
    joined = numbers.join(keyed(risks), "unit_id", "left").join(keyed(texts), "unit_id", "left")
    known = F.coalesce("risks", none)
    low = F.when(F.exists(known, lambda r: r.startswith("low_confidence")), F.array(F.lit("low_confidence"))).otherwise(none)
    return joined.select(
        "unit_id", F.lit("items").alias("field"),
        F.concat(F.col("candidate_count"), F.lit(" item candidate(s)")).alias("value"), "confidence",
        F.coalesce("evidence", F.lit("")).alias("evidence"), F.array_distinct(F.concat(known, low)).alias("risks"),
        "candidate_count", F.lit(False).alias("conflict"))


def low_confidence_risks(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Taint candidates that rest on badly read spans.

    A candidate is tainted if a span below the floor is its evidence, holds its value, or
    is held by it (from four characters on), also without separators. The candidate texts
    of a unit (a few dozen) travel to the spans, never the spans to one place.
    """
    low = spans.filter((F.col("confidence") < LOW_SPAN) & (F.trim("text") != "")).select(
        "unit_id", F.trim("text").alias("_text"), compact_number(F.col("text")).alias("_plain")).distinct()
    wanted = candidates.select("unit_id", "value", "evidence").distinct().groupBy("unit_id").agg(
        F.collect_list(F.struct("value", "evidence", compact_number(F.col("value")).alias("plain"))).alias("_wanted"))

    def touches(w: Column) -> Column:
        text, plain = F.col("_text"), F.col("_plain")
        return (
            (F.trim(w["evidence"]) == text) | text.contains(w["value"])
            | ((F.length(text) >= 4) & w["value"].contains(text))
            | ((F.length(plain) >= 4) & w["plain"].contains(plain))
        )

    hits = low.join(keyed(wanted), "unit_id").select("unit_id", F.explode(F.filter("_wanted", touches)).alias("_hit")).select(
        "unit_id", "_hit.value", "_hit.evidence").distinct().withColumn("_low", F.lit(True))
    flagged = candidates.join(keyed(hits), ["unit_id", "value", "evidence"], "left")
    tainted = F.array_union("risks", F.array(F.lit("low_confidence_ocr")))
    return flagged.withColumn("risks", F.when(F.col("_low"), tainted).otherwise(F.col("risks"))).drop("_low").select(
        *candidates.columns)
