"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_narrow


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``edges`` (a, b).

    Each step links every node's larger neighbours, then all its neighbours, to its
    smallest one; minima are aggregated before they are shuffled and joined back,
    so a hub's edges never meet in one task. Ends when all edges point to roots,
    after about log2(longest path) steps. Each step is written to the checkpoint folder.
    """
    start = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct()
    edges, parts = cut_narrow(start)
    while True:
        # Large star: both ends see the edge; a node's larger neighbours go to its smallest.
        both = edges.union(edges.select(F.col("a").alias("b"), F.col("b").alias("a"))).select(F.col("b").alias("node"), F.col("a").alias("other"))
        least = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("low"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("low").alias("other")).where("node <> other").coalesce(parts)
        # Small star: what is left points down; a node and its smaller neighbours go to the smallest.
        least = large.groupBy("node").agg(F.min("other").alias("low"))
        moved = large.join(least, "node")
        small = moved.select(F.col("other").alias("a"), F.col("low").alias("b")).union(moved.select(F.col("node").alias("a"), F.col("low").alias("b")))
        after, parts = cut_narrow(small.where("a <> b").coalesce(2 * parts).distinct())
        # Done when no node has two parents and no parent has one.
        ends = after.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(after.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            roots = after.select("b").distinct()
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
        edges = after.select("b", "a")
