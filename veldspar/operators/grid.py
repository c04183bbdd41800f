"""Partitions of attribute space into grids of cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import linear_cell
from ..storage import materialise
from .ranking import with_rank


def equi_width(points: DataFrame, shape: list[int]) -> DataFrame:
    """b0.. and cell_id: each attribute's range in equal widths, the top value in the last bucket."""
    aggs = [f(f"a{j}").cast("double").alias(f"{n}{j}") for j in range(len(shape)) for n, f in (("lo", F.min), ("hi", F.max))]
    out = points.crossJoin(F.broadcast(points.agg(*aggs)))  # one row
    for j, s in enumerate(shape):
        width = (F.col(f"hi{j}") - F.col(f"lo{j}")) / F.lit(float(s))
        place = F.when(width > 0, F.floor((F.col(f"a{j}") - F.col(f"lo{j}")) / width)).otherwise(F.lit(0))
        out = out.withColumn(f"b{j}", F.least(place, F.lit(s - 1)).cast("long"))
    out = out.drop(*[f"{n}{j}" for j in range(len(shape)) for n in ("lo", "hi")])
    return out.withColumn("cell_id", linear_cell([f"b{j}" for j in range(len(shape))], shape))


def by_id_range(points: DataFrame, cells: int) -> DataFrame:
    """cell_id: ids in equal ranges, the remainder in the last."""
    n = points.agg(F.max("id").alias("m"), F.min("id").alias("least"))
    width = F.greatest(F.lit(1), F.floor((F.col("m") - F.col("least") + 1) / F.lit(cells)))
    place = F.floor((F.col("id") - F.col("least")) / width)
    return points.crossJoin(F.broadcast(n)).withColumn("cell_id", F.least(place, F.lit(cells - 1)).cast("long")).drop("m", "least")


def equi_depth(points: DataFrame, shape: list[int]) -> DataFrame:
    """b0.. and cell_id: each attribute's sorted values, ties by id, in runs of ceil(N / s); the last bucket takes the rest.

    Null attributes are in no bucket and their points in no cell.
    """
    n = points.count()
    out = points
    for j, s in enumerate(shape):
        size = max(1, -(-n // s))
        ranked = with_rank(points.filter(F.col(f"a{j}").isNotNull()).select("id", f"a{j}"), [f"a{j}", "id"])
        bucket = F.least(F.floor(F.col("rank") / F.lit(size)), F.lit(s - 1)).cast("long")
        out = out.join(ranked.select("id", bucket.alias(f"b{j}")), "id", "left")
    return out.withColumn("cell_id", linear_cell([f"b{j}" for j in range(len(shape))], shape))


def bounds(gridded: DataFrame, attributes: int) -> DataFrame:
    """(dim, bucket, lo, hi): the least and greatest value of every bucket."""
    long = None
    for j in range(attributes):
        one = gridded.filter(F.col(f"b{j}").isNotNull()).groupBy(F.col(f"b{j}").alias("bucket")).agg(F.min(f"a{j}").alias("lo"), F.max(f"a{j}").alias("hi"))
        one = one.select(F.lit(j).cast("long").alias("dim"), F.col("bucket").cast("long"), "lo", "hi")
        long = one if long is None else long.unionByName(one)
    return long


def cell_boxes(gridded: DataFrame, attributes: int) -> DataFrame:
    """cell_id, n, and lo0, hi0, ...: the bounding box of the buckets of every non-empty cell."""
    edges = bounds(gridded, attributes)
    cells = gridded.filter(F.col("cell_id").isNotNull()).groupBy("cell_id", *[f"b{j}" for j in range(attributes)]).agg(F.count(F.lit(1)).alias("n"))
    for j in range(attributes):
        own = edges.filter(F.col("dim") == j).select(F.col("bucket").alias(f"b{j}"), F.col("lo").alias(f"lo{j}"), F.col("hi").alias(f"hi{j}"))
        cells = cells.join(F.broadcast(own), f"b{j}")  # as many rows as the grid has buckets in this dimension
    return cells


def value_counts(points: DataFrame, attribute: str = "a0") -> DataFrame:
    return points.filter(F.col(attribute).isNotNull()).groupBy(F.col(attribute).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def run_lengths(points: DataFrame, attribute: str = "a0") -> DataFrame:
    """(value, n, first): each run of equal values in sorted order and the place where it starts.

    Values are range-partitioned and written; sums run inside each range and are shifted by the sums of the ranges before.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(value_counts(points, attribute).repartitionByRange(n, "value").withColumn("_range", F.spark_partition_id()), "runs")
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(F.sum("n").alias("_n"))  # one row a range
    shifts = sums.select("_range", F.coalesce(F.sum("_n").over(earlier.orderBy("_range")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n").over(earlier.partitionBy("_range").orderBy("value")), F.lit(0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(shifts), "_range").select("value", "n", (F.col("_before") + F.col("_inside")).cast("long").alias("first"))


def tie_aware_cuts(n: int, parts: int, run_at: Callable[[int], tuple[int, int]]) -> list[int]:
    """Places in n sorted values where the parts begin; run_at gives the run of equal values around a place, as its first place and the one after its last.

    Ideal cuts are at p * n / parts, rounded half to even, and held so that every part keeps a value.  A cut inside a run moves to the nearer edge of the
    run (the lower of two as near) of those after the last cut that leave enough values; if there is none, or the run is at least twice a part long, the
    run is cut at the ideal place.
    """
    parts = min(parts, n)
    if not parts:
        return []
    long, cuts = 2 * -(-n // parts), [0]
    for p in range(1, parts):
        most = n - (parts - p)
        ideal = max(cuts[-1] + 1, min(round(p * n / parts), most))
        low, high = run_at(ideal)
        cut = ideal
        if low < ideal and high - low < long:
            cut = min((edge for edge in (low, high) if cuts[-1] < edge <= most), key=lambda edge: abs(edge - ideal), default=ideal)
        cuts.append(cut)
    return cuts


def best_split(counts: list[int], parts: int) -> list[int]:
    """First distinct value of each segment: at most parts runs of neighbouring values whose sizes are nearest to N / parts in squares.

    Dynamic programming over the value histogram; of splits as good the one with the earliest cuts.  As the cost of a run is convex in its size, the
    best place of a cut moves one way only, so each row of the table is filled by halving, in m log m steps.
    """
    m = len(counts)
    if parts >= m:
        return list(range(m))
    prefix = [0]
    for c in counts:
        prefix.append(prefix[-1] + c)
    aim = prefix[-1] / parts
    size = np.array(prefix, np.float64)
    cost = (size - aim) ** 2
    back = []
    for s in range(2, parts + 1):
        now, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(s, m, s - 1, m - 1)]  # ends from, to; last cuts from, to
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            i = (lo + hi) // 2
            k = slice(first, min(last, i - 1) + 1)
            c = cost[k] + (size[i] - size[k] - aim) ** 2
            j = int(np.argmin(c))
            now[i], at[i] = c[j], first + j
            todo += [(lo, i - 1, first, first + j), (i + 1, hi, first + j, last)]
        cost = now
        back.append(at)
    cuts, i = [], m
    for at in reversed(back):
        i = int(at[i])
        cuts.append(i)
    return [0, *reversed(cuts)]


#: A histogram of more distinct values than this is not brought to the driver.
MAX_SPLIT_VALUES = 1 << 16


def _histogram(points: DataFrame, attribute: str, most: int = MAX_SPLIT_VALUES) -> tuple[list, list[int]]:
    rows = value_counts(points, attribute).orderBy("value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{attribute} has over {most} distinct values; use equi_depth")
    return [r["value"] for r in rows], [r["n"] for r in rows]


def _tie_aware_cuts_of(points: DataFrame, parts: int, attribute: str) -> list[int]:
    """The cuts of an attribute.  Runs stay on the executors; those around the ideal cuts are looked up, at most one a part at a time."""
    runs = materialise(run_lengths(points, attribute), "tie-runs")
    n = int(runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"])
    known: list[tuple[int, int]] = []

    def look_up(places: list[int]) -> None:
        wanted = F.array(*[F.lit(x).cast("long") for x in places])
        around = runs.filter(F.exists(wanted, lambda x: (F.col("first") <= x) & (x < F.col("first") + F.col("n"))))
        known.extend((r["first"], r["first"] + r["n"]) for r in around.select("first", "n").collect())

    def run_at(place: int) -> tuple[int, int]:
        found = [r for r in known if r[0] <= place < r[1]]
        if not found:
            look_up([place])
            return run_at(place)
        return found[0]

    some = min(parts, n)
    if some > 1:
        look_up(sorted({max(p, min(round(p * n / some), n - (some - p))) for p in range(1, some)}))
    return tie_aware_cuts(n, parts, run_at)


def tie_aware(points: DataFrame, parts: int, attribute: str = "a0") -> DataFrame:
    """points with bucket: contiguous parts that split runs of equal values only if they are long."""
    cuts = _tie_aware_cuts_of(points, parts, attribute)
    ranked = with_rank(points.filter(F.col(attribute).isNotNull()), [attribute, "id"])
    starts = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    return ranked.withColumn("bucket", (F.size(F.filter(starts, lambda c: c <= F.col("rank"))) - 1).cast("long")).drop("rank")


def tie_aware_grid(points: DataFrame, shape: list[int]) -> DataFrame:
    """b0.. and cell_id: every attribute cut as by tie_aware; points with a null attribute are in no cell."""
    out = points
    for j, s in enumerate(shape):
        own = tie_aware(points.select("id", f"a{j}"), s, f"a{j}").select("id", F.col("bucket").alias(f"b{j}"))
        out = out.join(own, "id", "left")
    return out.withColumn("cell_id", linear_cell([f"b{j}" for j in range(len(shape))], shape))


def dp_split(points: DataFrame, parts: int, attribute: str = "a0") -> DataFrame:
    """points with bucket: whole runs of equal values, sizes as even as can be."""
    values, counts = _histogram(points, attribute)
    firsts = [values[i] for i in best_split(counts, parts)] if counts else []
    kind = points.schema[attribute].dataType
    starts = F.array(*[F.lit(v).cast(kind) for v in firsts]) if firsts else F.array().cast(f"array<{kind.simpleString()}>")
    known = points.filter(F.col(attribute).isNotNull())
    return known.withColumn("bucket", (F.size(F.filter(starts, lambda v: v <= F.col(attribute))) - 1).cast("long"))


def balance(parted: DataFrame, attribute: str = "a0", bucket: str = "bucket") -> DataFrame:
    """One row: parts, least, greatest, their difference, and spread of the parts' sizes, and how many values of the attribute stand in several parts."""
    sizes = parted.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    values = parted.groupBy(attribute).agg((F.min(bucket) < F.max(bucket)).cast("long").alias("several"))
    split = values.filter(F.col(attribute).isNotNull()).agg(F.coalesce(F.sum("several"), F.lit(0)).alias("split_values"))
    shape = sizes.agg(
        F.count(F.lit(1)).alias("parts"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
        (F.max("n") - F.min("n")).alias("difference"),
        F.round(F.stddev_pop("n"), 6).alias("spread"),
    )
    return shape.crossJoin(F.broadcast(split))  # one row with one row


def part_ranges(parted: DataFrame, attribute: str = "a0", bucket: str = "bucket") -> DataFrame:
    return parted.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min(attribute).alias("lo"), F.max(attribute).alias("hi"))


def cell_count(edges: DataFrame) -> DataFrame:
    """One row: cells of the grid of the buckets (dim, bucket)."""
    per = edges.groupBy("dim").agg(F.countDistinct("bucket").alias("s"))
    return per.agg(F.product("s").cast("long").alias("cells"))


def local_ids(gridded: DataFrame) -> DataFrame:
    """(id, cell_id, local_id): numbers from 0 inside each cell, by id.  Cells are of bounded size by design."""
    place = F.row_number().over(Window.partitionBy("cell_id").orderBy("id")) - 1
    return gridded.filter(F.col("cell_id").isNotNull()).select("id", "cell_id", place.cast("long").alias("local_id"))


def histogram(gridded: DataFrame) -> DataFrame:
    return gridded.filter(F.col("cell_id").isNotNull()).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


def offsets(gridded: DataFrame) -> DataFrame:
    """(cell_id, n, start): where each cell begins if points stand cell by cell."""
    w = Window.orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    return histogram(gridded).withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))
