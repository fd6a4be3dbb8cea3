"""Intermediate tables of the operators, and joins whose small side is measured before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlake.session import fresh_path

#: The largest side that is broadcast, in bytes as estimated from a count.
BROADCAST_BYTES = 32 << 20
#: What Spark sets for Arrow batches (as it may be written), and what whole texts ask for.
SMALL_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": (("10000",), "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": (("67108864b", "67108864", "64m", "64MB"), "4m"),
}


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: it is computed once, and a lost executor re-reads files.

    Narrow numbers hardly shrink, so they are not compressed; that also saves the writers' native buffers.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, size=None, row_bytes: int = 64) -> DataFrame:
    """df, marked for broadcast only if it measures BROADCAST_BYTES at most; beyond, the planner shuffles.

    size: a column that tells the bytes of a row besides row_bytes. df should be a staged table, as it is read for this.
    """
    more = F.lit(0) if size is None else size
    measured = df.agg(F.sum(more + row_bytes)).first()[0] or 0
    return F.broadcast(df) if measured <= BROADCAST_BYTES else df


def whole_texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of docs, to be read by Python workers; other columns are left behind.

    A batch of texts lies in the memory of the executor and again in the worker's, for each core. Where the session still has
    Spark's own batch size (10,000 rows, 64 MB), it is lowered to SMALL_BATCHES; a size of the user's choice stays. No result
    depends on it.
    """
    settings = docs.sparkSession.conf
    for key, (default, lower) in SMALL_BATCHES.items():
        if settings.get(key) in default:
            settings.set(key, lower)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among the distinct ids (doc_id); a null doc_id equals a null one.

    The ids that go are written and measured: few of them go by broadcast and no text is shuffled, many by a shuffle.
    """
    name = free_name(docs, "gone")
    gone = small(staged(ids.select(F.col("doc_id").alias(name)), "gone"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
