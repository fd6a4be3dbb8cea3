"""Connected components by contraction with random priorities, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voucherlake.llm.staging import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a long, b long); component is the smallest node reached.

    Each round a node moves to the neighbour (or itself) of the least random priority, and links are carried over
    to the nodes moved to. Priorities are drawn anew each round, so a long chain halves as a star does, whatever
    the order of its ids. The moves of all rounds, followed one after another, lead to the root of a component.
    Self links give a component of one node; links with a null end and repeated links are ignored.
    Every round is written to the shared folder: a lost executor re-reads files.
    """
    ends = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    open_links = staged(both.where("a <> b").distinct(), "links")
    moves = []
    while open_links.take(1):
        near = F.struct(F.xxhash64("b", F.lit(len(moves))).alias("p"), F.col("b").alias("to"))
        least = open_links.groupBy("a").agg(F.min(near).alias("n"))
        own = F.struct(F.xxhash64("a", F.lit(len(moves))).alias("p"), F.col("a").alias("to"))
        move = staged(least.select(F.col("a").alias("node"), F.least(F.col("n"), own)["to"].alias("to")), "moves")
        moves.append(move)
        carried = (
            open_links.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        )
        open_links = staged(carried.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if not moves:
        nodes = both.select(F.col("a").alias("node"), F.col("a").alias("root"))
    else:
        nodes = moves[0].select("node", F.col("to").alias("root"))
        for move in moves[1:]:
            step = move.select(F.col("node").alias("root"), "to")
            nodes = nodes.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        alone = ends.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
        nodes = nodes.unionByName(alone.join(moves[0].select("node"), "node", "left_anti"))
    nodes = staged(nodes.distinct(), "roots")
    least = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(least, "root").select("node", "component")
