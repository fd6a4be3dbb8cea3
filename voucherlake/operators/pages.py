"""Page quality, unit building and the merge of pages that say they belong together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voucherlake.functions import keys as K

GOOD_LENGTH = 40
PAGE_SEQUENCE = r"(?U)共\s*(\d+)\s*页\s*第\s*(\d+)\s*页"
# Fields every page of one invoice repeats.
IDENTITY_FIELDS = ("invoice_no", "invoice_date", "buyer_name", "buyer_tax_id", "seller_name", "seller_tax_id")


def page_quality(text_length: Column) -> Column:
    return F.when(text_length >= GOOD_LENGTH, F.lit("good")).when(text_length > 0, F.lit("poor")).otherwise(F.lit("none"))


def profile_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Add text_len, quality and ocr_required; only a page without any text must be read by OCR."""
    length = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return pages.withColumn("text_len", length).withColumn("quality", page_quality(F.col("text_len"))).withColumn(
        "ocr_required", F.col("quality") == "none")


def profile_files(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """File level: one quality if all pages agree, mixed if not, unknown without pages."""
    grouped = pages.groupBy("file").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.min("quality").alias("_low"), F.max("quality").alias("_high"),
        F.bool_or("ocr_required").alias("ocr_required"),
        F.bool_or(F.col("text_len") > 0).alias("has_text_layer"))
    if files is not None:
        grouped = files.select("file").join(grouped, "file", "left").withColumn(
            "page_count", F.coalesce("page_count", F.lit(0)))
    quality = F.when(F.col("_low").isNull(), F.lit("unknown")).when(
        F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.lit("mixed"))
    return grouped.select(
        "file", "page_count", quality.alias("text_layer_quality"),
        F.coalesce("ocr_required", F.lit(False)).alias("ocr_required"),
        F.coalesce("has_text_layer", F.lit(False)).alias("has_text_layer"),
        F.when(F.col("page_count") == 0, F.lit("failed")).otherwise(F.lit("ready")).alias("status"),
        F.when(F.col("page_count") == 0, F.lit("unsupported")).when(
            F.col("page_count") == 1, F.lit("single")).otherwise(F.lit("split_by_page")).alias("unit_strategy"))


def build_units(files: DataFrame, pages: DataFrame) -> DataFrame:
    """One unit per page or per single file; anything unreadable becomes one failed unit without pages.

    `files`: file, file_type, status, unit_strategy, content_sha (first 16 digits of the content hash), messages.
    """
    joined = files.join(pages.select("file", "page", F.col("ocr_required").alias("_page_ocr")), "file", "left")
    usable = (F.col("status") == "ready") & F.col("unit_strategy").isin("single", "split_by_page")
    ocr = F.coalesce("_page_ocr", F.lit(False))
    unit_type = (
        F.when(~usable, F.lit("unsupported"))
        .when((F.col("file_type") == "pdf") & ocr, F.lit("pdf_ocr_page"))
        .when(F.col("file_type") == "pdf", F.lit("pdf_page"))
        .when(F.col("file_type").isin("text", "markdown"), F.lit("text_file"))
        .when(F.col("file_type") == "xml", F.lit("xml"))
        .when(F.col("file_type") == "image", F.lit("image"))
        .otherwise(F.lit("unsupported"))
    )
    page_range = F.when(usable, F.array(F.coalesce("page", F.lit(1)).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return joined.withColumn("unit_type", unit_type).withColumn("page_range", page_range).select(
        unit_key(F.col("file"), F.col("page_range"), F.col("content_sha")).alias("unit_id"),
        F.col("file").alias("source_file"), "page_range", "unit_type",
        F.when(F.col("unit_type") == "unsupported", F.lit("failed")).otherwise(F.lit("ready")).alias("status"),
        F.when(F.col("unit_type") == "unsupported",
               F.coalesce("messages", F.lit("当前输入不能进入发票单元处理。"))).alias("messages"),
    ).distinct()


def unit_key(file: Column, page_range: Column, content_sha: Column) -> Column:
    name = F.element_at(F.split(file, r"[/\\]"), -1)
    part = F.when(F.size(page_range) > 0, F.array_join(page_range.cast("array<string>"), "-")).otherwise(F.lit("none"))
    seed = F.concat_ws("|", name, part, F.coalesce(content_sha, F.lit("missing")))
    return F.concat(F.lit("unit_"), F.substring(F.sha1(seed), 1, 16))


def page_sequence(text: Column) -> Column:
    """struct(pages, number) printed as 共 N 页 第 M 页, or null."""
    pages, number = F.regexp_extract(text, PAGE_SEQUENCE, 1), F.regexp_extract(text, PAGE_SEQUENCE, 2)
    return F.when(pages != "", F.struct(pages.try_cast("int").alias("pages"), number.try_cast("int").alias("number")))


def merge_pages(pages: DataFrame, identity: tuple[str, ...] = IDENTITY_FIELDS) -> DataFrame:
    """Join pages 1..N that print `共 N 页 第 M 页` and repeat the same full identity.

    Gaps and islands: page position minus printed number is constant in a run, so a run is one
    group, and it is confirmed iff it has exactly the numbers 1..N. A group holds at most
    N pages, since a position can carry a number only once. Pages read by OCR never merge.
    """
    sequence = F.when(F.coalesce(F.col("source") != "ocr", F.lit(True)), page_sequence(F.col("text")))
    blank = F.lit(False)
    for field in identity:
        blank = blank | (F.coalesce(F.trim(F.col(field).cast("string")), F.lit("")) == "")
    marked = pages.withColumn("_seq", sequence).withColumn(
        "_open", F.coalesce((F.col("_seq.pages") >= 2) & (F.col("_seq.number") >= 1), F.lit(False)) & ~blank)
    # A page outside any run is its own group, keyed by its position.
    run = marked.withColumn("_n", F.when(F.col("_open"), F.col("_seq.pages")).otherwise(F.lit(0)))
    run = run.withColumn("_start", F.when(F.col("_open"), F.col("page_idx") - F.col("_seq.number")).otherwise(F.col("page_idx")))
    run = run.withColumn("_who", F.when(F.col("_open"), K.stable_hash(*[F.trim(F.col(f).cast("string")) for f in identity])))
    confirmed = run.filter("_open").groupBy("file", "_n", "_start", "_who").agg(
        F.count(F.lit(1)).alias("_count"), F.min("_seq.number").alias("_min"), F.max("_seq.number").alias("_max"),
        F.min("page_idx").alias("first_page"),
    ).filter("_count = _n and _min = 1 and _max = _n").select("file", "_n", "_start", "_who", "first_page")
    joined = run.join(confirmed, ["file", "_n", "_start", "_who"], "left")
    first = F.coalesce("first_page", "page_idx")
    merged = F.col("first_page").isNotNull()
    return joined.select("file", "page_idx", first.alias("unit_page"), merged.alias("merged"),
                         F.when(merged, F.col("_n")).otherwise(F.lit(1)).alias("n_pages"))


def merged_units(assigned: DataFrame) -> DataFrame:
    """One row per unit with its page range; a range has at most the printed number of pages."""
    return assigned.groupBy("file", "unit_page").agg(
        F.array_sort(F.collect_set(F.col("page_idx").cast("int"))).alias("page_range"),
        F.bool_or("merged").alias("merged"))
