"""Connected components of an edge table by alternating large-star and small-star steps, with DataFrame operations only.

Each step re-hangs nodes under the smallest neighbour; steps end when nothing changes, after about the square of the logarithm of
the longest path.  Minima are pre-aggregated per task, so a node with very many neighbours is no hot key,
and as minima are written before they are joined to the edges, the skew-join rule can split those joins.  Edges stay on the executors, each step's are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _least(pairs: DataFrame) -> DataFrame:
    """The smaller of a node and its least neighbour."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.join(materialise(_least(both), "components"), "u").filter("v > u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(_least(down), "components")
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in an edge (u, v) of two numbers."""
    edges = materialise(edges.filter("u <> v").select("u", "v").distinct(), "components")
    before = None
    while True:
        edges = materialise(_small_star(_large_star(edges)), "components")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    hung = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.unionByName(hung.select(F.col("component").alias("node"), "component").distinct())
