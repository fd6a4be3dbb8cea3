"""A commit log for the tables of a ledger: a batch counts once its marker is written.

Every table of a ledger (rows, keys, notices, evidence, judged) is a folder whose files lie in partitions named by
batch_id. A batch writes its partitions one table after another and its marker last. Readers take batches with a marker only, so
what a failed attempt left behind is not seen, and the next attempt of the same batch replaces just that. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MARKERS = "commits"
BATCH = "batch_id"
MARKER_SCHEMA = f"{BATCH} string, run_id string, last_row long, added long, at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def markers(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, run_id, last_row, added, at): one row per committed batch."""
    folder = f"{path}/{MARKERS}"
    if not exists(spark, folder):
        return spark.createDataFrame([], MARKER_SCHEMA)
    return spark.read.schema(MARKER_SCHEMA).parquet(folder)


def is_committed(spark: SparkSession, path: str, batch_id: str) -> bool:
    return bool(markers(spark, path).filter(F.col(BATCH) == batch_id).take(1))


def commit(spark: SparkSession, path: str, batch_id: str, run_id: str, last_row: int, added: int) -> None:
    row = spark.createDataFrame([(batch_id, run_id, last_row, added)], "batch_id string, run_id string, last_row long, added long")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/{MARKERS}")


def last_row(spark: SparkSession, path: str) -> int:
    """The highest row number of the committed batches; no table but the markers is read."""
    return markers(spark, path).agg(F.max("last_row")).first()[0] or 0


def write(df: DataFrame, path: str, table: str, batch_id: str, keys: tuple[str, ...] = (), form: str = "parquet", **options: str) -> None:
    """Write a batch's part of a table; what an earlier attempt of the same batch wrote there is replaced, nothing else is."""
    part = df.withColumn(BATCH, F.lit(batch_id))
    spark, folder = df.sparkSession, f"{path}/{table}"
    leftover = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{BATCH}={_escaped(spark, batch_id)}")
    leftover.getFileSystem(spark._jsc.hadoopConfiguration()).delete(leftover, True)
    if form == "parquet":
        options = {"compression": "zstd"} | options
    part.write.mode("append").partitionBy(BATCH, *keys).options(**options).format(form).save(folder)


def written(df: DataFrame, path: str, table: str, batch_id: str, keys: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write a batch's part of a table and read back the columns of `df` from it, before the batch is committed."""
    write(df, path, table, batch_id, keys, **options)
    wanted = StructType([*df.schema, StructField(BATCH, StringType())])
    part = df.sparkSession.read.schema(wanted).parquet(f"{path}/{table}").filter(F.col(BATCH) == batch_id)
    return part.select(*df.columns)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark writes it in a path."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def read(spark: SparkSession, path: str, table: str, like: DataFrame | None = None, form: str = "parquet") -> DataFrame:
    """The committed rows of a table, with batch_id; before the first batch an empty one with the columns of `like`."""
    folder = f"{path}/{table}"
    wanted = StructType([f for f in like.schema if f.name != BATCH] + [StructField(BATCH, StringType())]) if like is not None else None
    if not exists(spark, folder):
        if wanted is None:
            raise FileNotFoundError(folder)
        return spark.createDataFrame([], wanted)
    if wanted is None:
        found = spark.read.format(form).load(folder).schema
        # names of batches and runs may look like numbers
        wanted = StructType([StructField(f.name, StringType()) if f.name in (BATCH, "run_id") else f for f in found])
    rows = spark.read.format(form).schema(wanted).load(folder)
    return rows.join(markers(spark, path).select(BATCH), BATCH, "left_semi").select(*wanted.fieldNames())
