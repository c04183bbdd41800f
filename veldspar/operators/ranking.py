"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialise


def with_rank(df: DataFrame, keys: list[str | Column], out: str = "rank") -> DataFrame:
    """df with its place, from 0, in the order of keys.

    Rows are range-partitioned and written, so that ranges stay fixed; places are counted inside each range and
    shifted by the sizes of the ranges before, of which there are as many as shuffle partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("_range", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    ranked = ranged.withColumn("_place", inside).join(F.broadcast(shifts), "_range")
    return ranked.withColumn(out, (F.col("_before") + F.col("_place") - 1).cast("long")).drop("_range", "_before", "_place")


def top_k(df: DataFrame, group: list[str], order: list[str], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark cuts each task's rows to k before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(out, place.cast("long")).filter(F.col(out) <= k)


def exclusive_sum(df: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """Running sum of the rows before; for tables of one row per cell or bucket."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))
