"""Later batches continue the same ledger: every micro-batch is judged and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voucherlake.operators import notices
from voucherlake.sources import sinks


def append_stream(
    source: DataFrame, ledger_path: str, checkpoint: str, order: list[str],
    to_rows: Callable[[DataFrame], DataFrame] | None = None, once: bool = True,
    to_notices: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Append the ledger rows of a stream.

    `to_rows` turns a micro-batch (documents or records) into ledger rows, `to_notices` gives notices of its own besides those
    of repeated rows. A micro-batch is a batch of the ledger named by the stream and its number: run again after a failure it
    gives the same rows, numbers and notices, and after its commit it writes nothing. The stream's name is the id that Spark keeps
    in the checkpoint, so a new checkpoint is a new stream.
    """
    def write(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_micro_batch(batch, ledger_path, order, f"{stream}-{number}", to_rows, to_notices)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_micro_batch(
    batch: DataFrame, ledger_path: str, order: list[str], batch_id: str,
    to_rows: Callable[[DataFrame], DataFrame] | None = None, to_notices: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """What append_stream does with one micro-batch."""
    rows = to_rows(batch) if to_rows else batch

    def told(judged: DataFrame) -> DataFrame:
        repeats = notices.duplicate_notices(judged, order)
        return repeats.unionByName(to_notices(batch)) if to_notices else repeats

    return sinks.append_batch(rows, ledger_path, order, batch_id, told=told)


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
