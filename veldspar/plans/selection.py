"""Cells of a query, its selectivity and strategy, and batches of cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sizes import broadcast_within, in_blocks
from ..storage import materialise

SCAN, CELLS, FULL = "scan", "cells", "full"


def _overlap(attributes: int, any_: bool) -> Column:
    def one(j: int) -> Column:
        lo, hi, l, r = (F.col(f"{x}{j}") for x in ("lo", "hi", "l", "r"))
        return (l.isNull() | (hi >= l)) & (r.isNull() | (lo <= r))

    return reduce((lambda x, y: x | y) if any_ else (lambda x, y: x & y), [one(j) for j in range(attributes)])


def query_cells(queries: DataFrame, cells: DataFrame, attributes: int, *, any_: bool = False) -> DataFrame:
    """(qid, cell_id): the cells whose box meets the query's.  cells has one row per grid cell, a number fixed by the grid's shape, and is broadcast."""
    return queries.join(broadcast_within(cells), _overlap(attributes, any_)).select("qid", "cell_id")


def query_cells_uniform(queries: DataFrame, edges: DataFrame, shape: list[int]) -> DataFrame:
    """The same on an equal-width grid, by arithmetic: the buckets from each interval's lower to its upper bound, multiplied out.

    edges is one row lo0, hi0, ... of attribute ranges.
    """
    out = queries.crossJoin(F.broadcast(edges))
    for j, s in enumerate(shape):
        lo, hi = F.col(f"lo{j}"), F.col(f"hi{j}")
        width = (hi - lo) / F.lit(float(s))

        def place(x: Column) -> Column:
            at = F.when(width > 0, F.floor((x - lo) / width)).otherwise(F.lit(0))
            return F.greatest(F.lit(0), F.least(at, F.lit(s - 1))).cast("long")

        low, high = F.coalesce(F.col(f"l{j}").cast("double"), lo), F.coalesce(F.col(f"r{j}").cast("double"), hi)
        out = out.filter((low <= hi) & (high >= lo) & (low <= high)).withColumn(f"b{j}", F.explode(F.sequence(place(low), place(high))))
    cell = reduce(lambda acc, js: acc * F.lit(js[1]) + F.col(f"b{js[0]}"), enumerate(shape), F.lit(0).cast("long"))
    return out.select("qid", cell.alias("cell_id"))


def cells_per_query(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("qid").agg(F.count(F.lit(1)).alias("n_cells"))


def overlap_area(queries: DataFrame, cells: DataFrame, attributes: int, threshold: float) -> DataFrame:
    """(qid, cell_id, area, is_little): the part of each visited cell's box that the query covers; little if at most threshold."""
    both = queries.join(broadcast_within(cells), _overlap(attributes, False))
    area = F.lit(1.0)
    for j in range(attributes):
        lo, hi, l, r = (F.col(f"{x}{j}") for x in ("lo", "hi", "l", "r"))
        width = (hi - lo).cast("double")
        cut = (F.least(hi, F.coalesce(r, hi)) - F.greatest(lo, F.coalesce(l, lo))).cast("double")
        area = area * F.when(width > 0, cut / width).otherwise(F.lit(1.0))
    return both.select("qid", "cell_id", area.alias("area")).withColumn("is_little", F.col("area") <= F.lit(threshold))


def little_cells(areas: DataFrame) -> DataFrame:
    return areas.groupBy("qid").agg(F.sum(F.col("is_little").cast("long")).alias("n_little"))


def all_little(areas: DataFrame, batches: DataFrame) -> DataFrame:
    """(qid, batch_id, all_little): whether all the cells of a batch that the query visits are little."""
    return areas.join(broadcast_within(batches), "cell_id").groupBy("qid", "batch_id").agg(F.bool_and("is_little").alias("all_little"))


def selectivity(points: DataFrame, queries: DataFrame, predicate: Column) -> DataFrame:
    """(qid, matches, selectivity): the share of all points in each query's box.

    Queries are broadcast to the scan, block by block if they are many; matches are counted per task before the shuffle.
    """
    n = points.agg(F.count(F.lit(1)).alias("n"))
    parts = [points.join(F.broadcast(own), predicate).groupBy("qid").agg(F.count(F.lit(1)).alias("matches")) for own in in_blocks(queries, "qid")]
    hits = reduce(DataFrame.unionByName, parts)  # a query is in one block
    out = queries.select("qid").join(hits, "qid", "left").crossJoin(F.broadcast(n))
    matches = F.coalesce("matches", F.lit(0)).cast("long")
    return out.select("qid", matches.alias("matches"), (matches / F.greatest("n", F.lit(1))).alias("selectivity"))


def estimated_selectivity(queries: DataFrame, cells: DataFrame, attributes: int) -> DataFrame:
    """(qid, least, most, estimate): bounds of how many points are in each query's box, and a guess between, from the cells' sizes n and bounding boxes alone.

    All points of a cell whose box lies inside the query's match, none of a cell outside of it, and any number of those between; the guess takes the covered part of their box.
    """
    area, whole = F.lit(1.0), F.lit(True)
    for j in range(attributes):
        lo, hi, l, r = (F.col(f"{x}{j}") for x in ("lo", "hi", "l", "r"))
        width = (hi - lo).cast("double")
        cut = (F.least(hi, F.coalesce(r, hi)) - F.greatest(lo, F.coalesce(l, lo))).cast("double")
        area = area * F.when(width > 0, cut / width).otherwise(F.lit(1.0))
        whole = whole & (l.isNull() | (l <= lo)) & (r.isNull() | (r >= hi))
    met = queries.join(broadcast_within(cells), _overlap(attributes, False)).select("qid", F.when(whole, F.col("n")).otherwise(0).alias("least"), F.col("n").alias("most"), F.when(whole, F.lit(1.0)).otherwise(area).alias("area"))
    sums = met.groupBy("qid").agg(F.sum("least").alias("least"), F.sum("most").alias("most"), F.sum(F.col("most") * F.col("area")).alias("estimate"))
    out = queries.select("qid").join(sums, "qid", "left")
    return out.select("qid", F.coalesce("least", F.lit(0)).cast("long").alias("least"), F.coalesce("most", F.lit(0)).cast("long").alias("most"), F.coalesce("estimate", F.lit(0.0)).alias("estimate"))


def selectivity_by_estimate(points: DataFrame, queries: DataFrame, cells: DataFrame, attributes: int, predicate: Column, threshold: float) -> DataFrame:
    """(qid, selectivity, exact): on the same side of the threshold as the true share of each query; points are counted only for queries whose bounds lie on both sides of it."""
    n = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    total = F.greatest("total", F.lit(1))
    guess = materialise(estimated_selectivity(queries, cells, attributes).crossJoin(F.broadcast(n)), "estimates")
    near = (F.col("least") / total <= threshold) & (F.col("most") / total > threshold)
    sure = guess.filter(~near).select("qid", (F.greatest("least", F.least("most", "estimate")) / total).alias("selectivity"), F.lit(False).alias("exact"))
    unsure = queries.join(guess.filter(near).select("qid"), "qid", "left_semi")
    return sure.unionByName(selectivity(points, unsure, predicate).select("qid", "selectivity", F.lit(True).alias("exact")))


def strategy(selected: DataFrame, counts: DataFrame, *, prefilter: float, postfilter: int) -> DataFrame:
    """(qid, selectivity, n_cells, strategy): scan if few points match, the whole graph if many cells are met, else cell by cell."""
    out = selected.join(counts, "qid", "left").withColumn("n_cells", F.coalesce("n_cells", F.lit(0)).cast("long"))
    choice = F.when(F.col("selectivity") <= prefilter, SCAN).when(F.col("n_cells") >= postfilter, FULL).otherwise(CELLS)
    return out.select("qid", "selectivity", "n_cells", choice.alias("strategy"))


def visit_order(chosen: DataFrame, nearest: DataFrame, cluster_cells: DataFrame) -> DataFrame:
    """(qid, cell_id, score, visit_rank): cells by how many points of the query's nearest clusters they hold, ties by cell."""
    score = chosen.join(nearest.select("qid", "cid"), "qid").join(cluster_cells, ["cell_id", "cid"]).groupBy("qid", "cell_id").agg(F.sum("n").alias("score"))
    out = chosen.join(score, ["qid", "cell_id"], "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("long"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "cell_id"))
    return out.withColumn("visit_rank", rank.cast("long"))


def batches(cells: DataFrame, per_batch: int) -> DataFrame:
    """(cell_id, batch_id): cells in order, per_batch together."""
    place = F.row_number().over(Window.orderBy("cell_id")) - 1
    return cells.select("cell_id").distinct().select("cell_id", F.floor(place / F.lit(per_batch)).cast("long").alias("batch_id"))


def batches_by_visits(chosen: DataFrame, cells: DataFrame, budget: int) -> DataFrame:
    """(cell_id, batch_id): cells that the same queries visit together, as many as the budget of points (cells has n) allows.

    A batch begins with the unplaced cell that most queries visit; the one that shares most visits with the batch is added as long as it fits, ties by cell.  Counts of
    cells and pairs of cells, all that the driver sees, are bounded by the grid's shape.
    """
    spark = chosen.sparkSession
    size = {r["cell_id"]: r["n"] for r in cells.select("cell_id", "n").collect()}
    other = chosen.select("qid", F.col("cell_id").alias("other"))
    together: dict[int, dict[int, int]] = {c: {} for c in size}
    for r in chosen.select("qid", "cell_id").join(other, "qid").groupBy("cell_id", "other").agg(F.count(F.lit(1)).alias("n")).collect():
        if r["cell_id"] in size and r["other"] in size:
            together[r["cell_id"]][r["other"]] = r["n"]
    left, rows, batch = set(size), [], 0
    while left:
        first = min(left, key=lambda c: (-together[c].get(c, 0), c))
        shared = dict(together[first])
        room = budget - size[first]
        left.remove(first)
        rows.append((first, batch))
        while fitting := [c for c in left if size[c] <= room and shared.get(c, 0)]:
            best = min(fitting, key=lambda c: (-shared[c], c))
            left.remove(best)
            rows.append((best, batch))
            room -= size[best]
            for c, n in together[best].items():
                shared[c] = shared.get(c, 0) + n
        batch += 1
    return spark.createDataFrame(rows, "cell_id long, batch_id long")


def query_batches(chosen: DataFrame, batches: DataFrame) -> DataFrame:
    """(qid, batch_id): the batches that each query has cells in."""
    return chosen.join(broadcast_within(batches), "cell_id").select("qid", "batch_id").distinct()


def queries_of_batch(queries: DataFrame, chosen: DataFrame, batch: DataFrame) -> DataFrame:
    """The queries that visit a cell of the batch."""
    touched = chosen.join(broadcast_within(batch.select("cell_id")), "cell_id", "left_semi").select("qid").distinct()
    return queries.join(touched, "qid", "left_semi")


def longest_first(chosen: DataFrame) -> DataFrame:
    """(qid, n_cells, place): queries in the order of work, those that visit most cells first, ties by query."""
    from ..operators.ranking import with_rank

    return with_rank(cells_per_query(chosen), [F.desc("n_cells"), "qid"], "place")
