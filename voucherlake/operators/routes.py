"""Choice between recognition routes, reuse of earlier results, and unions of routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlake.functions import keys as K
from voucherlake.operators.reports import UNSUPPORTED_TERMS

# Which outcome is better.
STATUS_RANK = {"ready": 3, "review_required": 2, "unmodeled": 1, "failed": 0}


def status_rank(status: Column) -> Column:
    rank = F.when(F.lit(False), F.lit(-1))
    for name, value in STATUS_RANK.items():
        rank = rank.when(status == name, F.lit(value))
    return rank.otherwise(F.lit(-1))


def needs_ocr(unit_type: Column, status: Column, decision: Column, reason: Column) -> Column:
    """A text page that is not ready and was not refused for its document type."""
    refused = F.lit(False)
    for term in UNSUPPORTED_TERMS:
        refused = refused | F.coalesce(reason, F.lit("")).contains(term)
    refused = refused & F.coalesce(decision == "unmodeled", F.lit(False))
    return (unit_type == "pdf_page") & (status != "ready") & ~refused


def ocr_worklist(results: DataFrame) -> DataFrame:
    """Units to be read by OCR: pages without text, and text pages whose result is not good enough."""
    image = F.col("unit_type").isin("image", "pdf_ocr_page")
    retry = needs_ocr(F.col("unit_type"), F.col("status"), F.col("decision"), F.col("reason"))
    return results.filter(image | retry).withColumn(
        "fallback_reason", F.when(image, F.lit("ocr_required")).otherwise(F.lit("direct_not_ready"))).withColumn(
        "unit_type", F.when(F.col("unit_type") == "pdf_page", F.lit("pdf_ocr_page")).otherwise(F.col("unit_type")))


def select_route(direct: DataFrame, ocr: DataFrame, payload: list[str]) -> DataFrame:
    """The better of two results per unit; OCR wins only if strictly better, and fields never mix.

    Both sides have unit_id, status and the payload columns; `direct` also `source`.
    """
    d = direct.select("unit_id", F.struct("status", "source", *payload).alias("d"))
    o = ocr.select("unit_id", F.struct("status", *payload).alias("o"))
    joined = d.join(o, "unit_id", "full_outer")
    only_ocr, only_direct = F.col("d").isNull(), F.col("o").isNull()
    better = status_rank(F.col("o.status")) > status_rank(F.col("d.status"))
    ocr_wins = only_ocr | (~only_direct & better)
    picked = [F.when(ocr_wins, F.col(f"o.{c}")).otherwise(F.col(f"d.{c}")).alias(c) for c in payload]
    return joined.select(
        "unit_id",
        F.when(ocr_wins, F.col("o.status")).otherwise(F.col("d.status")).alias("record_status"),
        *picked,
        F.when(ocr_wins, F.lit("ocr")).otherwise(F.col("d.source")).alias("selected_source"),
        (~only_ocr & ~only_direct).alias("fallback_attempted"),
        F.when(only_ocr, F.lit("ocr_required")).when(~only_direct, F.lit("direct_not_ready")).alias("fallback_reason"),
        F.col("d.status").alias("direct_status"),
        F.col("o.status").alias("ocr_status"),
        F.when(only_ocr, F.lit("ocr_required")).when(only_direct, F.lit("direct_ready_or_ocr_not_available"))
        .when(better, F.lit("ocr_status_higher")).otherwise(F.lit("same_or_higher_direct_status")).alias("selection_reason"),
    )


def reuse_results(todo: DataFrame, results: DataFrame, key_columns: list[str], payload: list[str]) -> DataFrame:
    """Attach earlier ready results by content fingerprint; rows without `reused` are the work list."""
    fingerprint = K.result_fingerprint(*[F.col(c) for c in key_columns])
    place = F.struct(*[F.col(c) for c in payload])
    known = results.filter("status = 'ready'").withColumn("_print", fingerprint).groupBy("_print").agg(
        F.min(place).alias("_hit"))
    return todo.withColumn("_print", fingerprint).join(known, "_print", "left").select(
        *todo.columns, *[F.col(f"_hit.{c}").alias(c) for c in payload], F.col("_hit").isNotNull().alias("reused"))


def union_routes(*parts: DataFrame) -> DataFrame:
    """Records of several routes as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def split_failures(parsed: DataFrame, valid: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and failed records for the rest; the batch goes on."""
    good = parsed.filter(F.col(valid))
    failed = parsed.filter(~F.coalesce(F.col(valid), F.lit(False))).withColumn("status", F.lit("failed")).withColumn(
        "remark", F.lit(reason)).withColumn("confidence", F.lit(0.0))
    return good, failed
