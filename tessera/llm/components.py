"""Connected components of an edge table by alternating star contractions; the edges of a hub are joined where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot

#: Edges of one node that a task joins, however few edges there are.
HUB = 100_000


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every greater neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows")).select("a", F.least("a", "m").alias("m"), "rows")
    return join_hot(both.filter("b > a"), least, "a", total, HUB).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every lesser neighbour of a node, and the node, are linked to the least of them. Edges go from the greater node a to the lesser b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
    moved = join_hot(edges, least, "a", total, HUB).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (columns a, b, of one type that can be ordered); root is the component's least node.

    Loops, repeated edges and either direction are allowed, null ends are not; no edges give an empty table. The rounds
    needed grow with the logarithm of the longest path; each is written to the checkpoint folder. A node with many
    neighbours is broadcast to their edges; a node with up to HUB of them is not a hub.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen, total = None, edges.count()
    while total:
        edges = cut(_small_star(_large_star(edges, total), total))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, total = now, now[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
