"""File listing, text files and positioned spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voucherlake.functions import keys as K

# File suffixes and what they are.
FILE_TYPES = {
    "pdf": "pdf", "md": "markdown", "txt": "text", "xml": "xml", "png": "image", "jpg": "image", "jpeg": "image",
    "bmp": "image", "tif": "image", "tiff": "image", "webp": "image",
}


def file_type(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"\.([a-z0-9]+)$", 1)
    pairs = [F.lit(x) for pair in FILE_TYPES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix), F.lit("unknown"))


LISTED = "file string, length bigint, modificationTime timestamp"


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """Zero-byte files of one folder. Spark leaves them out of every scan, so the folder is asked for them."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    statuses = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    names = [(s.getPath().toString(), 0, None) for s in statuses if s.isFile() and s.getLen() == 0]
    return spark.createDataFrame(names, LISTED)


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of one folder (not below it) with type and support flag; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    listed = listed.select(F.col("path").alias("file"), "length", "modificationTime").unionByName(empty_files(spark, path))
    return listed.withColumn("file_type", file_type(F.col("file"))).withColumn("supported", F.col("file_type") != "unknown")


TEXT_FILES = "*.{[tT][xX][tT],[mM][dD]}"


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents: one row per file with its trimmed, non-blank lines; an empty file is failed.

    Paths and contents come from one scan, so no name is compared with another; suffixes match in any case.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", TEXT_FILES).load(path)
    empty = empty_files(spark, path).select("file", F.lit("").alias("value"))
    texts = read.select(F.col("path").alias("file"), F.col("content").cast("string").alias("value")).unionByName(
        empty.filter(file_type(F.col("file")).isin("text", "markdown")))
    named = texts.withColumn("_name", F.element_at(F.split("file", "/"), -1))
    return named.select(
        K.unit_id(F.col("_name"), F.array(F.lit(1)), F.col("value")).alias("unit_id"), F.col("file").alias("source_file"),
        F.array(F.lit(1)).alias("page_range"), F.lit("text_file").alias("source"), text_lines(F.col("value")).alias("lines"),
    ).withColumn("status", F.when(F.size("lines") > 0, F.lit("ready")).otherwise(F.lit("failed"))).withColumn(
        "remark", F.when(F.size("lines") == 0, F.lit("文本文件为空，无法进入解析。")))


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r\n|\n|\r"), lambda t: F.trim(t)), lambda t: t != "")


def lines_table(docs: DataFrame) -> DataFrame:
    """Documents as one row per line, order dense from 1, without boxes."""
    zero = F.lit(0.0)
    return docs.select("unit_id", "source", F.posexplode("lines").alias("_pos", "text")).select(
        "unit_id", "source", F.lit(1).alias("page"), (F.col("_pos") + 1).alias("ord"), "text", zero.alias("x0"), zero.alias("y0"),
        zero.alias("x1"), zero.alias("y1"), F.lit(None).cast("double").alias("confidence"))


def scan_spans(df: DataFrame, source: str = "pdf_text") -> DataFrame:
    """Spans extracted elsewhere, made uniform: trimmed, blanks dropped, page 1 and zero box by default.

    `df` has unit_id and text, and optionally page, ord, x0, y0, x1, y1 and confidence. A missing order
    is taken from `block_no`, the position of the block in its file; one of the two must be there.
    """
    if "ord" not in df.columns and "block_no" not in df.columns:
        raise ValueError("spans need their order: a column ord or block_no")
    def column(name: str, default, kind: str) -> Column:
        known = F.col(name) if name in df.columns else F.lit(None)
        return F.coalesce(known.cast(kind), (default if isinstance(default, Column) else F.lit(default)).cast(kind)).alias(name)

    order = F.col("block_no") if "block_no" in df.columns else F.lit(1)
    return df.filter(F.trim("text") != "").select(
        "unit_id", F.lit(source).alias("source"), column("page", 1, "int"), column("ord", order, "int"), F.trim("text").alias("text"),
        *[column(n, 0.0, "double") for n in ("x0", "y0", "x1", "y1")],
        (F.col("confidence") if "confidence" in df.columns else F.lit(None)).cast("double").alias("confidence"))


def scan_ocr(df: DataFrame) -> DataFrame:
    """Recognition results with parallel arrays `texts`, `scores` and `polys` (corner points) as spans.

    Scores outside 0..1 are dropped; the box of a polygon is its extent.
    """
    zipped = df.select("unit_id", F.coalesce("page", F.lit(1)).alias("page") if "page" in df.columns else F.lit(1).alias("page"),
                       F.posexplode(F.arrays_zip("texts", "scores", "polys")).alias("_pos", "_b"))

    def extent(pick, index: int) -> Column:
        return F.coalesce(pick(F.transform("_b.polys", lambda p: p[index].cast("double"))), F.lit(0.0))

    score = F.col("_b.scores").cast("double")
    blocks = zipped.select(
        "unit_id", "page", (F.col("_pos") + 1).alias("ord"), F.col("_b.texts").alias("text"),
        extent(F.array_min, 0).alias("x0"), extent(F.array_min, 1).alias("y0"), extent(F.array_max, 0).alias("x1"),
        extent(F.array_max, 1).alias("y1"), F.when((score >= 0) & (score <= 1), score).alias("confidence"))
    return scan_spans(blocks, "ocr")


def split_blocks(blocks: DataFrame) -> DataFrame:
    """A block of several lines becomes one row per line; the height is divided evenly, the order goes on."""
    lines = F.split("text", "\r\n|\n|\r")
    size = F.size(F.col("_lines"))
    step = F.when(F.col("y1") > F.col("y0"), (F.col("y1") - F.col("y0")) / size).otherwise(F.lit(0.0))
    split = blocks.withColumn("_lines", lines).withColumn("_step", step).select(
        *[c for c in blocks.columns if c != "text"], "_step", F.posexplode("_lines").alias("_pos", "text"))
    top = F.col("y0") + F.col("_step") * F.col("_pos")
    return split.withColumn("_top", top).withColumn(
        "y1", F.when(F.col("_step") > 0, F.col("_top") + F.col("_step")).otherwise(F.col("y1"))).withColumn("y0", F.col("_top")).withColumn(
        "ord", F.col("ord") + F.col("_pos")).drop("_step", "_pos", "_top")
