"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split by map output, even if that costs a later exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows go from the aggregates straight to the writer; one partition fits one executor core.
    "spark.sql.files.maxPartitionBytes": "134217728",
    # Plans name the folders they read whole.
    "spark.sql.maxMetadataStringLength": "1000",
    "spark.ui.enabled": "false",
    # Noting the place in the program behind each of some ten thousand column calls takes as long as making them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("voucherlake")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, named by the cluster in spark.checkpoint.dir.

    Only where nothing is set and all tasks run inside the driver (tests on one machine) a scratch folder is made; a
    cluster must name one, for a folder of one machine is not seen by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="voucherlake-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    What is read several times afterwards is computed once, and a lost executor
    re-reads files instead of recomputing the whole plan.
    """
    path = fresh_path(df.sparkSession, name)
    # Ids are hex digests; a codec that codes single bytes halves them.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are sorted by the key.

    Without the hint adaptive execution judges such a side by its compressed size and sends it whole through the driver.
    """
    return df.hint("merge")
