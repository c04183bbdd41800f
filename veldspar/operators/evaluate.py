"""Recall against ground truth, reports, and sweeps of the beam's width."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise


def recall_per_query(result: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, hits, truth_size, recall): the share of the true ids that were found, 1 if there are none."""
    true = truth.select("qid", "id").distinct()
    found = result.select("qid", "id").distinct().withColumn("_hit", F.lit(1))
    per = true.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.count("_hit").alias("hits"), F.count(F.lit(1)).alias("truth_size"))
    all_ = queries.select("qid").join(per, "qid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long")).withColumn("truth_size", F.coalesce("truth_size", F.lit(0)).cast("long"))
    return all_.withColumn("recall", F.when(F.col("truth_size") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("truth_size")))


def recall(result: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    return recall_per_query(result, truth, queries).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("queries"))


def positional(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(same, truth_size): places of the truth where the result has the same id."""
    hit = result.select("qid", "rank", "id").withColumn("_hit", F.lit(1))
    return truth.select("qid", "rank", "id").join(hit, ["qid", "rank", "id"], "left").agg(F.count("_hit").alias("same"), F.count(F.lit(1)).alias("truth_size"))


def low_recall(result: DataFrame, truth: DataFrame, queries: DataFrame, below: float = 0.6) -> DataFrame:
    return recall_per_query(result, truth, queries).filter(F.col("recall") < below)


def empty_truth(truth: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.select("qid").join(truth.select("qid").distinct(), "qid", "left_anti")


def difference(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(gap, wrong): sum of absolute distance differences by place, and places present on one side only."""
    a = result.select("qid", "rank", F.col("dist").alias("d1"))
    b = truth.select("qid", "rank", F.col("dist").alias("d2"))
    both = a.join(b, ["qid", "rank"], "full")
    return both.agg(F.round(F.coalesce(F.sum(F.abs(F.col("d1") - F.col("d2"))), F.lit(0.0)), 6).alias("gap"), F.sum((F.col("d1").isNull() | F.col("d2").isNull()).cast("long")).alias("wrong"))


@dataclass
class Steps:
    """A beam search in its steps: cells of the queries, their order, and for a width finished states, whose answers and counters are asked for apart."""

    select: Callable[[], DataFrame]
    order: Callable[[DataFrame], DataFrame]
    search: Callable[[DataFrame, int], DataFrame]
    answers: Callable[[DataFrame], DataFrame]
    counters: Callable[[DataFrame], DataFrame]


METRICS = "ef long, recall double, qps double, total_s double, select_s double, order_s double, search_s double, kernel_s double, cells long, hops long, scored long"


def sweep(spark: SparkSession, steps: Steps, widths: list[int], truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One search for each beam width: its recall, queries a second, seconds in all and of selecting cells, ordering them, and searching, seconds of the walks themselves summed over tasks,
    cells visited, points expanded and distances computed.

    Every step's table is written, which is what ends its time; sums over the states are observed while their answers are written.
    """
    rows, n = [], queries.count()
    for width in widths:
        times = [time.perf_counter()]

        def written(df: DataFrame, name: str, times=times) -> DataFrame:
            out = materialise(df, name)
            times.append(time.perf_counter())
            return out

        ordered = written(steps.order(written(steps.select(), "sweep-cells")), "sweep-order")
        states = steps.search(ordered, width)
        seen = Observation()
        watched = steps.counters(states).observe(seen, *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seconds", "cells", "hops", "scored")])
        watched.write.format("noop").mode("overwrite").save()
        found = written(steps.answers(states), "sweep-answers")
        select_s, order_s, search_s = (b - a for a, b in zip(times, times[1:]))
        sums = seen.get
        share = float(recall(found, truth, queries).first()["recall"])
        rows.append((width, share, n / (times[-1] - times[0]), times[-1] - times[0], select_s, order_s, search_s, float(sums["seconds"]), sums["cells"], sums["hops"], sums["scored"]))
    return spark.createDataFrame(rows, METRICS)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").csv(path, header=True)
