"""Run counters, route counters, contract checks and expectation comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlake.operators.ledger import OUTPUT_PROFILE


def run_summary(rows: DataFrame, units: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """One row: units and rows by outcome. A unit with any row to review is not ready.

    `units`: one row per unit with source_file and record_status. `added`: result of dedup.
    """
    review = F.col("recognition_status") == "review_required"
    ready = F.col("recognition_status") == "ready"
    by_unit = rows.groupBy("unit_id").agg(
        F.count_if(ready).alias("_ready"), F.count_if(review).alias("_review"),
        F.bool_or(F.coalesce(F.trim("invoice_no"), F.lit("")) == "").alias("_weak"))
    from_rows = by_unit.agg(
        F.count_if((F.col("_ready") > 0) & (F.col("_review") == 0)).alias("ready_units"),
        F.count_if(F.col("_review") > 0).alias("review_required_units"),
        F.coalesce(F.sum("_ready"), F.lit(0)).alias("ready_rows"),
        F.coalesce(F.sum("_review"), F.lit(0)).alias("review_required_rows"),
        F.count_if("_weak").alias("weak_identity_units"),
    )
    by_file = units.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("_units"),
        F.count_if(F.col("record_status") == "unmodeled").alias("_unmodeled"),
        F.count_if(F.col("record_status") == "failed").alias("_failed"))
    from_units = by_file.agg(
        F.count(F.lit(1)).alias("input_count"),
        F.coalesce(F.sum("_units"), F.lit(0)).alias("invoice_units"),
        F.coalesce(F.sum("_unmodeled"), F.lit(0)).alias("unmodeled_units"),
        F.coalesce(F.sum("_failed"), F.lit(0)).alias("failed_units"))
    parts = [from_units, from_rows]
    if added is not None:
        counters = added.agg(
            F.coalesce(F.sum(F.when(F.col("action") != "skipped", F.when(F.coalesce(F.trim("invoice_no"), F.lit("")) == "", F.col("n_rows")).otherwise(F.lit(1)))), F.lit(0)).alias("added_rows"),
            F.coalesce(F.sum(F.when(F.col("action") == "skipped", F.col("n_rows"))
                             .when((F.col("action") == "added") & (F.coalesce(F.trim("invoice_no"), F.lit("")) != ""), F.col("n_rows") - 1)), F.lit(0)).alias("skipped_rows"))
        parts.append(counters)
    # Each part is one row; together they are one row with all counters.
    names = [c for part in parts for c in part.columns]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    summary = together.agg(*[F.max(c).alias(c) for c in names])
    return summary.withColumn("run_status", run_status())


def run_status() -> Column:
    blocked = F.col("failed_units") + F.col("unmodeled_units")
    return F.when(blocked == 0, F.lit("completed")).when(
        (F.col("ready_rows") > 0) | (F.col("review_required_rows") > 0), F.lit("partial")).otherwise(F.lit("uncompleted"))


def _pages() -> Column:
    return F.greatest(F.size("page_range"), F.lit(1))


def _ors(flags: dict[str, Column]) -> list[Column]:
    return [F.bool_or(F.coalesce(flag, F.lit(False))).alias(name) for name, flag in flags.items()]


def _count_files(by_file: DataFrame, names) -> DataFrame:
    return by_file.agg(
        *[F.count_if(n).alias(f"{n}_files") for n in names],
        F.coalesce(F.sum("pages"), F.lit(0)).alias("ocr_required_pages"))


def route_summary(results: DataFrame) -> DataFrame:
    """Files per recognition route, from selected results (see routes.select_route)."""
    structured = F.col("selected_source") == "structured"
    direct = ~structured & (F.col("selected_source").isin("pdf_text", "text_file") | F.col("direct_status").isNotNull())
    required = F.col("fallback_reason") == "ocr_required"
    attempted = F.col("fallback_attempted")
    broken = F.col("ocr_status").isin("failed", "unsupported")
    flags = {
        "direct": direct,
        "direct_ready": direct & (F.coalesce(F.col("direct_status"), F.col("record_status")) == "ready"),
        "structured": structured,
        "ocr_required": required,
        "ocr_fallback": attempted,
        "ocr_improved": attempted & (F.col("selection_reason") == "ocr_status_higher"),
        "ocr_failed": (F.coalesce(required, F.lit(False)) | F.coalesce(attempted, F.lit(False))) & broken,
    }
    pages = (F.when(required, _pages()).otherwise(0) + F.when(attempted, _pages()).otherwise(0))
    by_file = results.groupBy("source_file").agg(*_ors(flags), F.sum(pages).alias("pages"))
    return _count_files(by_file, flags)


# Words by which a decision says that a document type is not supported.
UNSUPPORTED_TERMS = ("未建模", "不支持", "未支持", "当前票种")


def preflight_report(results: DataFrame, ocr_enabled: bool, ocr_available: bool) -> DataFrame:
    """The same over a pass without OCR, with a verdict.

    `results`: source_file, selected_source, record_status, unit_type, page_range,
    fallback_attempted, fallback_reason, reason; a file without units has a null unit_type.
    """
    no_units = F.col("unit_type").isNull()
    image = F.col("unit_type").isin("image", "pdf_ocr_page")
    structured = F.col("selected_source") == "structured"
    direct = F.col("selected_source").isin("pdf_text", "text_file")
    required = ~structured & ~direct & image
    fallback = F.col("fallback_attempted") | F.coalesce(F.col("fallback_reason") == "direct_not_ready", F.lit(False))
    reason = F.coalesce("reason", F.lit(""))
    named = F.lit(False)
    for term in UNSUPPORTED_TERMS:
        named = named | reason.contains(term)
    stuck = (F.col("selected_source") == "none") & ~image & ~F.coalesce(F.col("fallback_reason") == "direct_not_ready", F.lit(False))
    flags = {
        "direct": direct,
        "direct_ready": direct & (F.col("record_status") == "ready"),
        "structured": structured,
        "ocr_required": required,
        "ocr_fallback": fallback,
        "unsupported": no_units | (F.col("record_status").isin("unmodeled", "failed") & (stuck | named)),
    }
    pages = F.when(F.coalesce(required, F.lit(False)), _pages()).otherwise(0) + F.when(
        F.coalesce(fallback, F.lit(False)), _pages()).otherwise(0)
    by_file = results.groupBy("source_file").agg(*_ors(flags), F.sum(pages).alias("pages"))
    report = _count_files(by_file, flags)
    due = F.col("ocr_required_pages") > 0
    status = F.when(due & F.lit(ocr_enabled and not ocr_available), F.lit("ocr_required")).when(
        due & F.lit(not ocr_enabled), F.lit("blocked")).otherwise(F.lit("passed"))
    code = F.when(status == "ocr_required", 3).when(status == "blocked", 2).otherwise(0)
    return report.withColumn("status", status).withColumn("return_code", code)


# ---- output contract -----------------------------------------------------

def profile_table(spark: SparkSession, profile: dict = OUTPUT_PROFILE) -> DataFrame:
    rows = [
        (key, spec["name"], field, header, required)
        for key, spec in profile.items() for field, header, required, _source in spec["fields"]
    ]
    return spark.createDataFrame(rows, "table_key string, table_name string, field string, header string, required boolean")


def contract_check(headers: DataFrame, profile: DataFrame) -> DataFrame:
    """Violations of a target's headers: missing table, missing required field, duplicate and extra header.

    `headers(table_name, header)` has one row per column of the target, repeats included.
    Only extra headers do not block the write.
    """
    found = headers.withColumn("header", F.trim("header"))
    tables = profile.select("table_key", "table_name").distinct()
    missing_table = tables.join(found.select("table_name").distinct(), "table_name", "left_anti").select(
        "table_key", F.lit("missing_sheet").alias("violation"), F.lit("").alias("subject"), F.lit(True).alias("blocks"))
    here = profile.join(found.select("table_name").distinct(), "table_name", "left_semi")
    # A field is there if any of its aliases is.
    matched = here.join(found.distinct(), ["table_name", "header"]).select("table_key", "field").distinct()
    missing = here.filter("required").select("table_key", "field").distinct().join(
        matched, ["table_key", "field"], "left_anti").select(
        "table_key", F.lit("missing_required_field").alias("violation"), F.col("field").alias("subject"),
        F.lit(True).alias("blocks"))
    known = found.join(tables, "table_name")
    duplicate = known.groupBy("table_key", "header").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "table_key", F.lit("duplicate_header").alias("violation"), F.col("header").alias("subject"), F.lit(True).alias("blocks"))
    extra = known.select("table_key", "header").distinct().join(
        profile.select("table_key", "header").distinct(), ["table_key", "header"], "left_anti").select(
        "table_key", F.lit("extra_header").alias("violation"), F.col("header").alias("subject"), F.lit(False).alias("blocks"))
    return missing_table.unionByName(missing).unionByName(duplicate).unionByName(extra)


# ---- expectations --------------------------------------------------------

def compare_expected(actual: DataFrame, expected: DataFrame, fields: list[str]) -> DataFrame:
    """Failures (file, issue): absent files on either side, unit count, and differing values.

    Both sides have `file` and the fields as text; `actual` has one row per unit, `expected` one per file.
    A null expectation is not checked.
    """
    counted = actual.groupBy("file").agg(
        F.count(F.lit(1)).alias("_units"), *[F.min(f).alias(f"_{f}") for f in fields])
    absent = expected.select("file").join(counted.select("file"), "file", "left_anti").select(
        "file", F.lit("expected file is missing").alias("issue"))
    surplus = counted.select("file").join(expected.select("file"), "file", "left_anti").select(
        "file", F.lit("file has no expectation").alias("issue"))
    joined = counted.join(expected, "file")
    units = joined.filter("_units <> 1").select(
        "file", F.concat(F.lit("expected one invoice unit, got "), F.col("_units")).alias("issue"))
    single = joined.filter("_units = 1")
    checks = F.array(*[
        F.when(F.col(f).isNotNull() & ~F.col(f).cast("string").eqNullSafe(F.col(f"_{f}").cast("string")),
               F.concat(F.lit(f"{f}: expected "), F.col(f).cast("string"), F.lit(", got "),
                        F.coalesce(F.col(f"_{f}").cast("string"), F.lit("None"))))
        for f in fields])
    differing = single.select("file", F.explode(checks).alias("issue")).filter("issue is not null")
    return absent.unionByName(surplus).unionByName(units).unionByName(differing)


def missing_values(actual_lines: DataFrame, expected_lines: DataFrame) -> DataFrame:
    """Expected (file, field, value) line values that no line of the file has."""
    return expected_lines.distinct().join(
        actual_lines.select("file", "field", "value").distinct(), ["file", "field", "value"], "left_anti"
    ).select("file", F.concat(F.lit("items."), "field", F.lit(": missing "), "value").alias("issue"))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, tagged with the side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
