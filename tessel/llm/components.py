"""Connected components of a graph by alternating large-star and small-star steps, all in DataFrame operations.

Each step is a grouped minimum (combined before the shuffle) joined back to the edges on the same key, so a hub with a third
of all edges is a skewed join with one row per key on the other side, which adaptive execution splits. Nothing but one
answer for each round, whether all edges are stars by now, comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settled, skew_join


def _stars(edges: DataFrame) -> bool:
    """Whether each node above has one edge, to a node that has none above it."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 - root").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return skew_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = skew_join(edges, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, kind: str = "long", ready: bool = False) -> DataFrame:
    """edges(u, v) -> (node, component): the least node of each component, for every node that has an edge to another.

    kind is the nodes' type. Loops and repeated edges are fine, null ends are dropped, no edges give no rows. ready says that edges
    are a stored table without any of these.
    """
    edges = edges.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before = None
    if not ready:
        edges = before = settled(edges.distinct())
    for _ in range(max_rounds):
        if _stars(edges):
            break
        edges = settled(_small_star(_large_star(edges)))
        if before is not None:
            forget(before)
        before = edges
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
