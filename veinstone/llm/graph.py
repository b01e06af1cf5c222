"""Connected components by alternating large-star and small-star steps; every step is a group-by and a join, or a window in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


#: Edges of a partition: as many partitions as the graph asks for, so that a round is not mostly empty files.
TASK_EDGES = 500_000


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)).alias("s")).head()
    return row["n"], row["s"]


def _beside(edges: DataFrame, parts: int) -> DataFrame:
    """Each row (a, b) with m, the smallest b of its a. One partition needs no shuffle for that."""
    if parts == 1:
        return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the edges (a long, b long): label is the smallest node that it reaches.

    Self-loops, repeated edges and either direction are fine; no edges give an empty table. Only two numbers a round
    reach the driver. Groups are cut to their minimum before the shuffle, so a node with very many edges is no burden.
    A graph of up to ``TASK_EDGES`` edges is one partition: its rounds are one task each and shuffle nothing.
    """
    now = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = _stamp(now)
    for _ in range(most_rounds):
        parts = -(-stamp[0] // TASK_EDGES) or 1
        there, back = F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
        both = now.coalesce(parts).select(F.explode(F.array(there, back)).alias("e")).select("e.a", "e.b")
        # Large star: neighbours above a, and a itself (in the row of its least neighbour), to the least of a and its neighbours.
        least = _beside(both, parts).withColumn("m", F.least("m", "a")).filter("b > a or b = m")
        large = least.select(F.greatest("a", "b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: neighbours below a, and a itself, to the least of them.
        now = cut(_beside(large, parts).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        before, stamp = stamp, _stamp(now)
        if stamp == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    now = now.coalesce(-(-stamp[0] // TASK_EDGES) or 1)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label")))
