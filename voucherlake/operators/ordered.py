"""Windows that stay exact when one group holds a large share of all rows.

A group is cut into chunks by its numeric position. Work inside a chunk is an
ordinary window over (keys, chunk); what crosses a chunk border is carried by a
small table with one row per chunk. No task ever sees a whole hot group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voucherlake.session import keyed

CHUNK = 4096


def _chunk(position: str, size: int) -> Column:
    return F.floor(F.col(position) / size)


def _carried(chunks: DataFrame, keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def neighbours(
    df: DataFrame, keys: Sequence[str], position: str, value: str, before: int, after: int, size: int = CHUNK
) -> DataFrame:
    """Add arrays `prev` (nearest last) and `next` (nearest first) of the neighbouring values.

    `position` must be dense inside a group (1, 2, 3, ...). Rows near a chunk
    border are copied into the neighbouring chunk and dropped again afterwards.
    """
    pos = F.col(position)
    home = _chunk(position, size)
    homes = F.sequence(_floor(pos - after, size), _floor(pos + before, size))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(homes))
    ordered = Window.partitionBy(*keys, "_chunk").orderBy(position)
    framed = spread
    if before:
        framed = framed.withColumn("prev", F.collect_list(value).over(ordered.rowsBetween(-before, -1)))
    if after:
        framed = framed.withColumn("next", F.collect_list(value).over(ordered.rowsBetween(1, after)))
    return framed.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def _floor(value: Column, size: int) -> Column:
    return F.floor(value / size)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, size: int = CHUNK
) -> DataFrame:
    """Inclusive running sum inside a group; `order[0]` is the numeric position."""
    chunked = df.withColumn("_chunk", _chunk(order[0], size)).withColumn("_value", value)
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    offsets = totals.withColumn(
        "_offset", F.coalesce(F.sum("_total").over(_carried(totals, keys)), F.lit(0))
    ).drop("_total")
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.withColumn("_local", F.sum("_value").over(local))
    return (
        summed.join(keyed(offsets), [*keys, "_chunk"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_chunk", "_value", "_local", "_offset")
    )


def position_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, size: int = CHUNK
) -> DataFrame:
    """Dense 1-based position; `order[0]` is numeric, the rest break ties."""
    return running_sum(df, keys, order, F.lit(1), name, size)


def last_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, size: int = CHUNK
) -> DataFrame:
    """Last non-null value on an earlier row of the group."""
    chunked = df.withColumn("_chunk", _chunk(order[0], size)).withColumn("_value", value)
    place = F.struct(*order)
    ends = chunked.filter("_value is not null").groupBy(*keys, "_chunk").agg(
        F.max_by("_value", place).alias("_end")
    )
    all_chunks = chunked.select(*keys, "_chunk").distinct().join(keyed(ends), [*keys, "_chunk"], "left")
    carried = all_chunks.withColumn(
        "_carry", F.last("_end", ignorenulls=True).over(_carried(all_chunks, keys))
    ).drop("_end")
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        chunked.withColumn("_near", F.last("_value", ignorenulls=True).over(local))
        .join(keyed(carried), [*keys, "_chunk"])
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_chunk", "_value", "_near", "_carry")
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every group.

    The rank filter is applied on the map side too, so each task sends one row per group.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
