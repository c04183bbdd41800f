"""Command line: exact search of exchange files, and the sweep of beam widths.

    python -m veldspar search --base a.fvecs --queries q.fvecs --attrs a.attrs --ranges r.bin --out answers
    python -m veldspar sweep  --base a.fvecs --queries q.fvecs --attrs a.attrs --ranges r.bin --shape 4,4 --widths 10,50,100 --out metrics

Answers are written as Parquet (qid, rank, id, dist), metrics as CSV (recall, queries a second, and seconds and counts by step).  Without attributes and ranges the search has no filter.
The session is the caller's if spark-submit or a test made one.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cells as beams
from .operators import clusters as C
from .operators import evaluate as E
from .operators import graph as G
from .operators import grid as R
from .operators import search as Q
from .plans import selection as S
from .sources import binary as B
from .storage import materialise, owned


def numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def options(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="veldspar", description="Range-filtered nearest-neighbour search on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("search", "exact nearest neighbours in boxes"), ("sweep", "recall and speed of beams by their width")):
        one = commands.add_parser(name, help=about)
        one.add_argument("--base", required=True, help="vectors: .u8bin, else float vectors each led by its dimension")
        one.add_argument("--queries", required=True, help="query vectors, in the same formats")
        one.add_argument("--attrs", help="attributes of the base")
        one.add_argument("--ranges", help="closed intervals of the queries, one for every attribute")
        one.add_argument("--k", type=int, default=10)
        one.add_argument("--any", action="store_true", help="join intervals by OR")
        one.add_argument("--out", required=True)
        if name == "sweep":
            one.add_argument("--shape", type=numbers, default=[4, 4], help="buckets of every attribute")
            one.add_argument("--widths", type=numbers, default=[10, 20, 50, 100, 200, 500, 1000])
            one.add_argument("--degree", type=int, default=16, help="edges of a point within its cell")
            one.add_argument("--cross", type=int, default=2, help="edges of a point into every other cell")
            one.add_argument("--descent", action="store_true", help="build the cells' graphs by NN-Descent and the edges across cells by beams, instead of comparing all pairs")
            one.add_argument("--clusters", type=int, default=16, help="clusters that order the cells")
    chosen = parser.parse_args(argv)
    if (chosen.attrs is None) != (chosen.ranges is None):
        parser.error("--attrs and --ranges go together")
    if chosen.command == "sweep" and chosen.attrs is None:
        parser.error("sweep needs --attrs and --ranges")
    return chosen


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    return B.read_u8bin(spark, path) if path.endswith(".u8bin") else B.read_fvecs(spark, path)


def load(spark: SparkSession, chosen: argparse.Namespace) -> tuple[DataFrame, DataFrame, int]:
    """Points (id, vec, a0, ...), queries (qid, qvec, l0, r0, ...), and how many attributes there are."""
    base = _vectors(spark, chosen.base)
    queries = _vectors(spark, chosen.queries).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    if chosen.attrs is None:
        return base, queries, 0
    n = B.header(chosen.attrs, 2, kind="I")[1]
    return base.join(B.read_attributes(spark, chosen.attrs), "id"), queries.join(B.read_ranges(spark, chosen.ranges, n), "qid"), n


def sweep(spark: SparkSession, chosen: argparse.Namespace) -> DataFrame:
    base, queries, n = load(spark, chosen)
    if len(chosen.shape) != n:
        raise ValueError(f"--shape names {len(chosen.shape)} attributes, the file has {n}")
    queries = materialise(queries, "queries")
    cells = materialise(R.equi_depth(materialise(base, "base"), chosen.shape), "grid")
    if chosen.descent:
        edges, cross = materialise(G.descend(cells, chosen.degree, prune=True), "edges"), None
    else:
        edges, cross = materialise(G.cell_graph(cells, chosen.degree), "edges"), materialise(G.cross_edges(cells, chosen.cross), "cross")
    labels, centres, _ = C.kmeans(cells, chosen.clusters)
    nearest, held = materialise(C.nearest(queries, centres), "nearest"), materialise(C.cluster_cells(cells, labels), "cluster-cells")
    boxes = materialise(R.cell_boxes(cells, n), "cells")
    truth = materialise(Q.exact_blocks(cells, queries, n, chosen.k, any_=chosen.any), "truth")
    index = beams.write_index(cells, edges, cross, n, r=chosen.cross)
    steps = E.Steps(
        select=lambda: S.query_cells(queries, boxes, n, any_=chosen.any),
        order=lambda met: S.visit_order(met, nearest, held),
        search=lambda ordered, width: beams.walk(index, queries, ordered, width=width, recycle=width, any_=chosen.any),
        answers=lambda states: beams.answers(states, chosen.k),
        counters=beams.counters,
    )
    return E.sweep(spark, steps, chosen.widths, truth, queries)


def main(argv: Sequence[str] | None = None) -> None:
    chosen = options(argv)
    spark = SparkSession.builder.appName("veldspar").getOrCreate()
    with owned(spark) as tables:
        if chosen.command == "sweep":
            E.write_metrics(sweep(spark, chosen), chosen.out)
        else:
            points, queries, n = load(spark, chosen)
            Q.exact_blocks(points, queries, n, chosen.k, any_=chosen.any).write.mode("errorifexists").parquet(chosen.out)
    tables.drop()


if __name__ == "__main__":
    main()
