"""Cells larger than one task, dealt into overlapping parts of bounded size.

A cell of more points than the limit is cut by a hyperplane: along the direction in which a sample of it varies most, at the middle of the sample's projections.  Points nearer
to the middle than a share `overlap` of the cell on either side go to both halves, so that near points which the plane parts still meet.  Halves that are too large are cut again.
Only directions and cuts come from the sample (about SAMPLE points a part, by hash of the id); every point is dealt by its own projection.
Points that lie on a cut with most of their cell, such as copies, are dealt by hash of the id, so every cut makes both halves smaller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.sizes import broadcast_within
from ..shipping import ship
from ..storage import materialise

#: Points of a part that its direction and cut come from, about.
SAMPLE = 1024
PART = ["cell_id", "part"]


def _axis(x: np.ndarray) -> np.ndarray:
    """The direction in which points vary most."""
    x = x - x.mean(0)
    axis = np.linalg.eigh(x.T @ x)[1][:, -1] if len(x) > x.shape[1] else np.linalg.svd(x, full_matrices=False)[2][0]
    return axis if axis[np.abs(axis).argmax()] > 0 else -axis


def _direction(pdf: pd.DataFrame) -> pd.DataFrame:
    axis = _axis(np.stack(pdf["vec"].to_numpy()).astype(np.float64))
    return pd.DataFrame({"cell_id": [pdf["cell_id"].iloc[0]], "part": [pdf["part"].iloc[0]], "axis": [axis.tolist()]})


def dealt(points: DataFrame, limit: int, *, overlap: float = 0.15) -> DataFrame:
    """(cell_id, part, id, vec): points (cell_id, id, vec) in parts of at most `limit`, a point in one part at least; a cell that fits is one part, named ''.

    A cut is a pass over the points that are in parts too large, whose copies grow by at most a share 2 x overlap; parts halve, so n points take log2(n / limit) passes and a little more.
    """
    if limit < 2 or not 0 <= overlap < 0.25:
        raise ValueError("a part needs room for two points, and an overlap must be below a quarter")
    ship(points.sparkSession)
    now = points.select("cell_id", F.lit("").alias("part"), "id", F.col("vec").cast("array<double>").alias("vec"))
    done = None
    while True:
        large = materialise(now.groupBy(*PART).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit), "part-sizes")
        fit = now.join(broadcast_within(large.select(*PART)), PART, "left_anti")
        done = fit if done is None else done.unionByName(fit)
        if large.isEmpty():
            return done
        rest = now.join(broadcast_within(large), PART)
        drawn = materialise(rest.filter(F.pmod(F.xxhash64("id", "part"), F.col("n")) < SAMPLE).drop("n"), "part-sample")
        axes = materialise(drawn.groupBy(*PART).applyInPandas(_direction, "cell_id long, part string, axis array<double>"), "part-axes")
        at = V.dot("vec", "axis")
        of_sample = drawn.join(broadcast_within(axes), PART).select(*PART, "axis", at.alias("at"))
        shares = F.array(*[F.lit(s) for s in (0.5 - overlap, 0.5 + overlap)])
        cut = of_sample.groupBy(*PART).agg(F.first("axis").alias("axis"), F.percentile("at", shares).alias("cut"))
        cuts = materialise(cut.select(*PART, "axis", F.col("cut")[0].alias("low"), F.col("cut")[1].alias("high")), "part-cuts")
        sided = rest.join(broadcast_within(cuts), PART, "left").withColumn("at", at)  # a part whose sample is empty has no cut, and is dealt by hash
        left = F.coalesce(F.col("at") < F.col("high"), F.lit(False))
        right = F.coalesce(F.col("at") > F.col("low"), F.lit(False))
        by_hash = F.when(F.pmod(F.xxhash64("part", "id"), F.lit(2)) == 0, F.array(F.lit("l"))).otherwise(F.array(F.lit("r")))
        sides = F.when(left & right, F.array(F.lit("l"), F.lit("r"))).when(left, F.array(F.lit("l"))).when(right, F.array(F.lit("r"))).otherwise(by_hash)
        halves = sided.select("cell_id", "part", F.explode(sides).alias("side"), "id", "vec")
        now = materialise(halves.select("cell_id", F.concat("part", "side").alias("part"), "id", "vec"), "parts")


def cut_within(x: np.ndarray, limit: int, *, overlap: float = 0.15, seed: int = 1) -> Iterator[np.ndarray]:
    """Places of the points, in parts of at most `limit`, that the same cuts make of a part at hand; points on a cut with most of their part are dealt by turns."""
    rng, todo = np.random.default_rng(seed), [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= limit:
            yield at
            continue
        own = x[at]
        drawn = rng.choice(len(at), SAMPLE, replace=False) if len(at) > SAMPLE else slice(None)
        along = (own * _axis(own[drawn])).sum(1)  # equal points have equal sums
        low, high = np.quantile(along[drawn], [0.5 - overlap, 0.5 + overlap])
        left, right = along < high, along > low
        on_cut = np.flatnonzero(~(left | right))
        left[on_cut[::2]] = right[on_cut[1::2]] = True
        todo += [at[left], at[right]]


def merge_into(near: np.ndarray, dist: np.ndarray, rank: np.ndarray, at: np.ndarray, more: np.ndarray, more_dist: np.ndarray, *, by_rank: bool = False) -> None:
    """Merge the lists `more` (places, -1 for none) of the points at `at`, nearest first, into the lists near, dist, rank, which keep their length and each neighbour once, as `merged` does."""
    n, k = near.shape
    ids = np.concatenate([near[at], more], axis=1)
    d = np.concatenate([dist[at], np.where(more >= 0, more_dist, np.inf)], axis=1)
    r = np.concatenate([rank[at], np.where(more >= 0, np.arange(1, more.shape[1] + 1), len(near) + k)], axis=1)
    order = np.lexsort((ids, d, r) if by_rank else (ids, d), axis=1)
    ids, d, r = (np.take_along_axis(v, order, 1) for v in (ids, d, r))
    again = ((ids[:, :, None] == ids[:, None, :]) & np.tri(ids.shape[1], k=-1, dtype=bool)).any(2) | (ids < 0)
    first = np.argsort(again, axis=1, kind="stable")[:, :k]
    gone = np.take_along_axis(again, first, 1)
    near[at] = np.where(gone, -1, np.take_along_axis(ids, first, 1))
    dist[at] = np.where(gone, np.inf, np.take_along_axis(d, first, 1))
    rank[at] = np.where(gone, len(near) + k, np.take_along_axis(r, first, 1))


def merged(lists: DataFrame, degree: int, *, by_rank: bool = False) -> DataFrame:
    """(cell_id, src, rank, dst): of the lists (cell_id, src, rank, dst, dist) that the parts have of one point, the first `degree` neighbours, each once.

    They come by distance; with by_rank by their rank in the part, and then by distance, so that every part's first choices stay.  Pairs of one point are at most parts times degree.
    """
    order = ["rank", "dist", "dst"] if by_rank else ["dist", "dst"]
    per = lists.groupBy("cell_id", "src").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("near"))
    first = F.slice(F.array_distinct(F.transform("near", lambda x: x["dst"])), 1, degree)
    return per.select("cell_id", "src", F.posexplode(first).alias("rank", "dst")).select("cell_id", "src", (F.col("rank") + 1).cast("long").alias("rank"), "dst")
