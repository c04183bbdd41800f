"""Clusters of vectors and their spread over grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_within
from ..functions.vectors import l2_squared
from .ranking import top_k


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, cid): the nearest centroid, ties to the smaller cid.  Centroids (cid, vec), of a stated number, are broadcast and folded into one row."""
    packed = centroids.agg(F.sort_array(F.collect_list(F.struct("cid", F.col("vec").alias("v")))).alias("centres"))
    both = points.crossJoin(F.broadcast(packed))
    scored = F.transform("centres", lambda c: F.struct(l2_squared(F.col("vec"), c["v"]).alias("d"), c["cid"].alias("cid")))
    return both.select("id", F.array_min(scored)["cid"].alias("cid"))


def means(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, vec): the mean of each cluster's members, dimension by dimension."""
    long = points.join(labels, "id").select("cid", F.posexplode("vec").alias("dim", "x"))
    per = long.groupBy("cid", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = per.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("p"))
    return ordered.select("cid", F.transform("p", lambda s: s["x"]).alias("vec"))


def cluster_cells(gridded: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, cid, n): members of each cluster in each cell."""
    return gridded.join(labels, "id").groupBy("cell_id", "cid").agg(F.count(F.lit(1)).alias("n"))


def nearest(queries: DataFrame, centroids: DataFrame, r: int = 4) -> DataFrame:
    """(qid, cid, dist, rank): the r nearest centroids of each query."""
    both = queries.select("qid", "qvec").join(broadcast_within(centroids))
    scored = both.select("qid", "cid", l2_squared("qvec", "vec").alias("dist"))
    return top_k(scored, ["qid"], ["dist", "cid"], r)


def kmeans(points: DataFrame, k: int, *, seed: int = 1, iterations: int = 20) -> tuple[DataFrame, DataFrame, dict]:
    """Labels (id, cid), centroids (cid, vec), and inertia and iterations of a fit by the machine-learning library."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = points.sparkSession
    data = points.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(data)
    labels = model.transform(data).select("id", F.col("prediction").cast("long").alias("cid"))
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cid long, vec array<double>")
    return labels, centres, {"inertia": float(model.summary.trainingCost), "iterations": int(model.summary.numIter)}
