"""Hand-made fixtures for the search engine."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar import workload
from veldspar.functions import predicates as P
from veldspar.functions import vectors as V
from veldspar.operators import evaluate as E
from veldspar.operators import graph as G
from veldspar.operators import grid as R
from veldspar.operators import search as Q
from veldspar.plans import selection as S
from veldspar.sources import binary as B

POINTS = "id long, vec array<float>, a0 long, a1 long"
QUERIES = "qid long, qvec array<float>, l0 long, r0 long, l1 long, r1 long"


def points(spark, rows):
    return spark.createDataFrame(rows, POINTS)


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), QUERIES)


def small(spark, n=60):
    rng = np.random.default_rng(0)
    return points(spark, [(i, [float(x) for x in rng.normal(size=4)], int(rng.integers(0, 6)), i * 7919 % 100) for i in range(n)])


def ids(df):
    return [(r["qid"], r["id"]) for r in df.orderBy("qid", "rank").collect()]


def test_equal_distances_go_to_smaller_ids(spark):
    p = points(spark, [(i, [1.0, 0.0], 0, 0) for i in (4, 2, 9, 7)])
    q = asked(spark, (0, [0.0, 0.0], None, None, None, None))
    for found in (Q.exact(p, q, 2, 2), Q.exact_blocks(p, q, 2, 2)):
        assert ids(found) == [(0, 2), (0, 4)]


def test_short_answers_have_no_padding(spark):
    p = points(spark, [(i, [float(i), 0.0], 1, i) for i in range(9)])
    q = asked(spark, (0, [0.0, 0.0], 1, 1, 0, 2))
    assert ids(Q.exact(p, q, 2, 10)) == ids(Q.exact_blocks(p, q, 2, 10)) == [(0, 0), (0, 1), (0, 2)]


def test_or_box_null_attribute_and_open_bounds(spark):
    p = points(spark, [(0, [0.0], 5, 50), (1, [0.0], 5, 1), (2, [0.0], None, 1), (3, [0.0], None, None)])
    q = asked(spark, (0, [0.0], 4, 6, 40, None))
    assert ids(Q.exact(p, q, 2, 9)) == ids(Q.exact_blocks(p, q, 2, 9)) == [(0, 0)]
    assert ids(Q.exact(p, q, 2, 9, any_=True)) == ids(Q.exact_blocks(p, q, 2, 9, any_=True)) == [(0, 0), (0, 1)]


def test_blocks_of_queries_and_ways_of_search_agree(spark):
    p = small(spark)
    q = p.filter("id < 7").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), (F.col("a0") - 1).alias("l0"), (F.col("a0") + 1).alias("r0"), F.lit(5).cast("long").alias("l1"), F.lit(90).cast("long").alias("r1"))
    want = ids(Q.exact(p, q, 2, 5))
    assert ids(Q.exact_blocks(p, q, 2, 5, block=2)) == want
    assert ids(Q.chunk_merged(p, q, 2, 5, 3)) == want
    g = R.equi_depth(p, [2, 3])
    chosen = S.query_cells(q, R.cell_boxes(g, 2), 2)
    assert ids(Q.prefilter(g, q, chosen, 2, 5)) == want


def test_empty_tables(spark):
    p, q = points(spark, []), asked(spark, (0, [0.0], 0, 1, 0, 1))
    assert Q.exact(p, q, 2, 3).count() == Q.exact_blocks(p, q, 2, 3).count() == 0
    assert Q.exact_blocks(small(spark), asked(spark), 2, 3).count() == 0
    assert R.equi_depth(p, [2, 2]).count() == 0
    assert R.tie_aware(p, 3).count() == R.dp_split(p, 3).count() == 0


def test_equi_depth_splits_ties_by_id(spark):
    values = [1, 1, 1, 1, 1, 1, 2, 3, 4, 5]
    p = points(spark, [(i, [0.0], v, 0) for i, v in enumerate(values)])
    got = {r["id"]: r["b0"] for r in R.equi_depth(p, [4]).collect()}
    assert [got[i] for i in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]


def cuts_by_walking(values, parts):
    """Cuts of a sorted list, found by walking from each ideal place to where the value changes."""
    n = len(values)
    parts = min(parts, n)
    cuts = [0]
    for p in range(1, parts):
        place = max(cuts[-1] + 1, min(round(p * n / parts), n - parts + p))
        if values[place - 1] == values[place] and values.count(values[place]) < 2 * math.ceil(n / parts):
            for step in range(1, n):  # the lower edge first, at each distance
                nearer = [x for x in (place - step, place + step) if cuts[-1] < x <= n - parts + p and (values[x - 1] != values[x])]
                inside = [x for x in nearer if values[min(x, place)] == values[max(x, place) - 1]]
                if inside:
                    place = inside[0]
                    break
        cuts.append(place)
    return cuts


def cuts_of(counts, parts):
    starts = np.concatenate([[0], np.cumsum(counts)])

    def run_at(place):
        i = int(np.searchsorted(starts, place, side="right")) - 1
        return int(starts[i]), int(starts[i + 1])

    return R.tie_aware_cuts(int(starts[-1]), parts, run_at)


def test_tie_aware_cuts():
    assert cuts_of([6, 1, 1, 1, 1], 4) == [0, 2, 5, 8]  # the run is two parts long, so it is split
    assert cuts_of([4, 1, 1, 1, 1, 1, 1], 2) == [0, 5]
    assert cuts_of([2, 5, 3], 2) == [0, 7]  # the nearer edge of the middle run
    assert cuts_of([1, 1], 5) == [0, 1]
    assert cuts_of([13], 2) == [0, 6]  # no edge is allowed, so the ideal place stays
    assert cuts_of([1, 8, 1], 4) == [0, 2, 5, 8] == cuts_by_walking([0] + [1] * 8 + [2], 4)
    r = random.Random(6)
    for _ in range(20000):
        counts = [r.choice([1, 1, 2, 3, 5, 13]) for _ in range(r.randint(1, 9))]
        parts = r.randint(1, 7)
        assert cuts_of(counts, parts) == cuts_by_walking([v for v, c in enumerate(counts) for _ in range(c)], parts), (counts, parts)


def test_tie_aware_parts_and_their_sql_match_walking(spark):
    import duckdb

    from veldspar import catalog

    r = random.Random(7)
    for parts in (1, 2, 3, 5, 6):
        counts = [r.choice([1, 2, 3, 5, 13]) for _ in range(r.randint(2, 7))]
        values = [v * 10 for v, c in enumerate(counts) for _ in range(c)]
        cuts = cuts_by_walking(values, parts)
        want = [(i, sum(c <= i for c in cuts) - 1) for i in range(len(values))]
        p = points(spark, [(i, [0.0], v, 0) for i, v in enumerate(values)] + [(999, [0.0], None, 0)])
        assert sorted((x["id"], x["bucket"]) for x in R.tie_aware(p, parts).collect()) == want
        con = duckdb.connect()
        con.execute("CREATE TABLE pts AS SELECT unnest(range(?)) AS id, unnest(?) AS a0", [len(values), values])
        assert sorted(con.execute(f"WITH RECURSIVE {catalog.tie_aware_sql('a0', parts, 'bucket', 'ta')} SELECT id, bucket FROM ta").fetchall()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_best_split_is_optimal(counts, parts):
    from itertools import combinations

    aim = sum(counts) / min(parts, len(counts)) if parts < len(counts) else None
    cuts = R.best_split(counts, parts)
    if parts >= len(counts):
        assert cuts == list(range(len(counts)))
        return

    def cost(c):
        edges = [*c, len(counts)]
        return sum((sum(counts[a:b]) - aim) ** 2 for a, b in zip(edges, edges[1:]))

    assert abs(cost(cuts) - min(cost([0, *c]) for c in combinations(range(1, len(counts)), parts - 1))) < 1e-9


def test_boxes_in_gaps_outside_and_on_bounds(spark):
    p = points(spark, [(i, [0.0], v, 0) for i, v in enumerate([0, 5, 10, 20, 25, 30])])
    cells = R.cell_boxes(R.equi_depth(p, [2, 1]), 2)
    q = asked(spark, (0, [0.0], 12, 18, None, None), (1, [0.0], 99, 200, None, None), (2, [0.0], 10, 10, None, None))
    assert [(r["qid"], r["cell_id"]) for r in S.query_cells(q, cells, 2).collect()] == [(2, 0)]


def test_quantisation_of_constant_and_positive_dimensions(spark):
    p = points(spark, [(0, [3.0, 10.0], 0, 0), (1, [3.0, 20.0], 0, 0)])
    params = V.quantisation(p)
    got = {r["dim"]: (r["scale"], r["zp"]) for r in params.collect()}
    assert got[0] == (0.0, 0) and got[1][1] == -128
    codes = {r["id"]: list(r["codes"]) for r in V.quantised(p, params).collect()}
    assert codes[0][0] == codes[1][0] == 0 and codes[1][1] == 127
    exact = V.quantisation(p, clamp=False)
    approx = {r["id"]: r["approx"] for r in V.dequantised(V.quantised(p, exact), exact).collect()}
    assert abs(approx[1][1] - 20) < 0.05 and abs(approx[0][1] - 10) < 0.05


def test_rerank_keeps_every_row_within_the_error_of_the_codes(spark):
    # All but two rows fall on one code; the nearest has the largest id, so a fixed number of candidates misses it.
    rows = [(i, [0.4 - i * 0.001, 0.0], 0, 0) for i in range(100)] + [(200, [-1000.0, 0.0], 0, 0), (201, [1000.0, 0.0], 0, 0)]
    p, q = points(spark, rows), asked(spark, (0, [0.3, 0.0], None, None, None, None))
    q = q.withColumn("qvec", F.array(F.lit(0.301), F.lit(0.0)))
    exact = V.quantisation(p, clamp=False)
    got = Q.from_codes(V.quantised(p, exact), p, exact, q, 3, 10)
    assert ids(got) == ids(Q.exact(p, q, 0, 3)) == [(0, 99), (0, 98), (0, 97)]


def test_graphs_beam_and_full_graph(spark):
    g = R.equi_depth(small(spark), [2, 2])
    edges, cross = G.cell_graph(g, 4), G.cross_edges(g, 2, block=16)
    assert edges.groupBy("src").count().filter("count <> 4").count() == 0
    assert cross.filter("src = dst").count() == 0
    q = asked(spark, (0, [0.0] * 4, None, None, None, None), (1, [1.0] * 4, None, None, None, None))
    order = S.query_cells(q, R.cell_boxes(g, 2), 2).withColumn("visit_rank", F.col("cell_id") + 1)
    want = ids(Q.exact(g, q, 2, 5))
    assert ids(Q.by_cells(g, edges, cross, q, order, 2, 5, width=100)) == want
    got = Q.over_graph(g, G.assembled(edges, cross, g), q, G.entry_points(g, 2), 2, 5, width=60)
    assert ids(got) == want


def test_full_graph_search_goes_on_until_no_row_is_left_to_expand(spark):
    n = 36  # a chain of more hops than a fixed number of rounds would go
    p = points(spark, [(i, [float(i)], 0, 0) for i in range(n)]).coalesce(1)
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long").coalesce(1)
    q = asked(spark, (0, [float(n)], None, None, None, None))
    assert ids(Q.over_graph(p, edges, q, p.filter("id = 0").select("id"), 2, 2, width=2)) == [(0, n - 1), (0, n - 2)]


def test_beam_misses_a_component_but_a_wide_one_does_not():
    x = np.array([[0.0], [0.1], [5.0], [5.1]])
    adjacency = [np.array([1]), np.array([0]), np.array([3]), np.array([2])]
    for width, walk in ((2, False), (99, True)):
        rows, _, hops = Q.beam(x, np.arange(4), adjacency, np.array([5.0]), np.array([0]), width, walk=walk)
        assert set(rows) == {0, 1} and hops == 2
    rows, _, _ = Q.beam(x, np.arange(4), adjacency, np.array([5.0]), np.array([0]), 4)
    assert set(rows) == {0, 1, 2, 3}


def test_representatives(spark):
    edges = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 0), (0, 2, 1, 1), (0, 3, 1, 2)], "cell_id long, src long, rank long, dst long")
    assert {r["id"]: r["rep_id"] for r in G.representatives(edges).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}


def test_recall_of_empty_truth_is_one(spark):
    q = asked(spark, (0, [0.0], 0, 0, 0, 0), (1, [0.0], 0, 0, 0, 0))
    truth = spark.createDataFrame([(1, 1, 7, 0.0), (1, 2, 8, 0.0)], Q.RESULT)
    found = spark.createDataFrame([(1, 1, 8, 0.0)], Q.RESULT)
    per = {r["qid"]: r["recall"] for r in E.recall_per_query(found, truth, q).collect()}
    assert per == {0: 1.0, 1: 0.5}
    assert E.positional(found, truth).first()["same"] == 0
    assert [r["qid"] for r in E.empty_truth(truth, q).collect()] == [0]


def test_strategies_and_batches(spark):
    g = R.equi_depth(small(spark), [2, 2])
    cells = R.cell_boxes(g, 2)
    q = asked(spark, (0, [0.0] * 4, None, None, None, None), (1, [0.0] * 4, 0, 0, 0, 3))
    chosen = S.query_cells(q, cells, 2)
    plan = S.strategy(S.selectivity(g, q, P.box(2)), S.cells_per_query(chosen), prefilter=0.2, postfilter=4)
    assert {r["qid"]: r["strategy"] for r in plan.collect()} == {0: "full", 1: "scan"}
    assert S.batches(cells, 3).select("batch_id").distinct().count() == 2


def test_record_files(spark, tmp_path):
    p = small(spark, 30)
    B.write_fvecs(p, str(tmp_path / "a.fvecs"))
    got = B.read_fvecs(spark, str(tmp_path / "a.fvecs"))
    assert got.join(p, ["id"]).filter(got["vec"] != p["vec"]).count() == 0 and got.count() == 30
    B.write_attributes(p, str(tmp_path / "a.attrs"), 2)
    assert B.read_attributes(spark, str(tmp_path / "a.attrs")).exceptAll(p.select("id", "a0", "a1")).count() == 0
    raw = (tmp_path / "a.attrs").read_bytes()
    (tmp_path / "bad.attrs").write_bytes(raw[:-4])
    with pytest.raises(ValueError):
        B.read_attributes(spark, str(tmp_path / "bad.attrs"))
    (tmp_path / "v.u8bin").write_bytes(np.array([2, 3], "<u4").tobytes() + bytes([1, 2, 255, 4, 5, 6]))
    assert [list(r["vec"]) for r in B.read_u8bin(spark, str(tmp_path / "v.u8bin"), as_float=False).orderBy("id").collect()] == [[1, 2, 255], [4, 5, 6]]
    (tmp_path / "x").write_bytes(np.array([2, 4], "<u4").tobytes() + np.array([0, 1, 1, 0, 1, 0, 0, 1], "<u4").tobytes())
    rows = B.read_cross_graph(spark, str(tmp_path / "x"), 2, [0, 10]).collect()
    assert {(r["src"], r["dst_cell"], r["rank"]): r["dst"] for r in rows}[(0, 1, 1)] == 11
    g = R.equi_depth(p, [2, 2])
    B.write_grid(g, R.bounds(g, 2), [2, 2], str(tmp_path / "g"))
    edges, cells = B.read_grid(spark, str(tmp_path / "g"))
    assert cells.exceptAll(g.select("id", "b0", "b1", "cell_id")).count() == 0 and edges.count() == 4


def test_workloads(spark):
    r = workload.ranges_of_selectivity(spark.range(50).withColumnRenamed("id", "qid"), 2, 1000, 0.1)
    assert r.filter("r0 - l0 <> 99 OR r1 - l1 <> 99 OR l0 < 0 OR r0 >= 1000").count() == 0
    s = workload.stratified_attribute(spark.range(64), 4, 1000)
    assert {x["count"] for x in s.groupBy("cell_id").count().collect()} == {16}


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_half_precision():
    assert V.half(np.array([1.0, 0.1], np.float32), 2.0).dtype == np.float16


def test_command_line(spark, tmp_path):
    from veldspar.__main__ import main

    p = small(spark, 80)
    q = p.filter("id % 20 = 0").select((F.col("id") / 20).cast("long").alias("qid"), F.col("vec").alias("qvec"), *[F.lit(x).cast("long").alias(n) for n, x in (("l0", 1), ("r0", 4), ("l1", 10), ("r1", 90))])
    name = {n: str(tmp_path / n) for n in ("base.fvecs", "q.fvecs", "attrs", "ranges", "answers", "open", "metrics", "descent")}
    B.write_fvecs(p, name["base.fvecs"])
    B.write_fvecs(q.select(F.col("qid").alias("id"), F.col("qvec").alias("vec")), name["q.fvecs"])
    B.write_attributes(p, name["attrs"], 2)
    B.write_ranges(q, name["ranges"], 2)
    files = ["--base", name["base.fvecs"], "--queries", name["q.fvecs"]]
    boxes = ["--attrs", name["attrs"], "--ranges", name["ranges"], "--k", "5"]
    main(["search", *files, *boxes, "--out", name["answers"]])
    assert ids(spark.read.parquet(name["answers"])) == ids(Q.exact(p, q, 2, 5))
    main(["search", *files, "--out", name["open"]])
    assert ids(spark.read.parquet(name["open"])) == ids(Q.exact(p, q, 0, 10))
    main(["sweep", *files, *boxes, "--shape", "2,2", "--widths", "4,80", "--clusters", "3", "--degree", "4", "--out", name["metrics"]])
    rows = spark.read.csv(name["metrics"], header=True, inferSchema=True).orderBy("ef").collect()
    assert [r["ef"] for r in rows] == [4, 80] and rows[0]["recall"] <= rows[1]["recall"] >= 0.9 and all(r["qps"] > 0 for r in rows)
    assert all(abs(r["select_s"] + r["order_s"] + r["search_s"] - r["total_s"]) < 1e-6 and r["kernel_s"] > 0 for r in rows)
    assert rows[0]["hops"] < rows[1]["hops"] and rows[0]["scored"] <= rows[1]["scored"] and rows[0]["cells"] == rows[1]["cells"]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "veldspar"
    before = set(shared.iterdir())
    main(["sweep", *files, *boxes, "--shape", "2,2", "--widths", "80", "--clusters", "3", "--degree", "4", "--descent", "--out", name["descent"]])
    assert spark.read.csv(name["descent"], header=True, inferSchema=True).first()["recall"] >= 0.9
    assert set(shared.iterdir()) == before  # what the command wrote on its way is gone
    for wrong in (["search", *files, "--attrs", "x", "--out", "y"], ["sweep", *files, "--out", "y"]):
        with pytest.raises(SystemExit):
            main(wrong)


def test_rerank_by_blocks_of_queries(spark):
    p = small(spark, 200)
    q = p.filter("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), *[F.lit(None).cast("long").alias(n) for n in ("l0", "r0", "l1", "r1")])
    exact = V.quantisation(p, clamp=False)
    want = ids(Q.exact(p, q, 0, 7))
    for block in (3, 4096):
        assert ids(Q.from_codes(V.quantised(p, exact), p, exact, q, 7, 9, block=block)) == want
    assert Q.from_codes(V.quantised(p, exact), p, exact, q.limit(0), 7, 9).count() == 0
    assert Q.from_codes(V.quantised(p, exact).limit(0), p.limit(0), exact, q, 7, 9).count() == 0


def test_places_among_bounds_and_split_values(spark):
    p = spark.createDataFrame([(0, 5, 0), (1, 10, 0), (2, 10, 1), (3, 31, 1), (4, None, 1)], "id long, a0 long, bucket long")
    bounds = F.array(F.lit(10), F.lit(20), F.lit(30))
    got = [tuple(r) for r in p.filter("a0 IS NOT NULL").orderBy("id").select(V.upper_bound(bounds, F.col("a0")), V.lower_bound(bounds, F.col("a0"))).collect()]
    assert got == [(0, 0), (0, 0), (0, 0), (2, 3)]
    assert R.balance(p).first()["split_values"] == 1


@pytest.mark.parametrize("mounted", [True, False])
def test_sinks_write_rows_where_they_belong(spark, tmp_path, monkeypatch, mounted):
    begin = B._Sink.__init__

    def opened(self, path):
        begin(self, path)
        self.mounted = mounted  # else as on a store of objects, where files are made of parts

    monkeypatch.setattr(B._Sink, "__init__", opened)
    monkeypatch.setattr(B, "ROWS_AT_ONCE", 7)
    rng = np.random.default_rng(1)
    vec = rng.normal(size=(300, 3)).astype(np.float32)
    order = rng.permutation(300)
    p = spark.createDataFrame([(int(i), [float(v) for v in vec[i]], int(i) * 3 % 50) for i in order], "id long, vec array<float>, a0 long").repartition(5)
    B.write_fvecs(p, f"{tmp_path}/a.fvecs")
    raw = np.fromfile(f"{tmp_path}/a.fvecs", np.uint8).reshape(300, 16)
    assert (raw[:, :4].copy().view("<i4") == 3).all() and (raw[:, 4:].copy().view("<f4") == vec).all()
    B.write_numbers(p, f"{tmp_path}/n", "a0")
    assert np.fromfile(f"{tmp_path}/n", "<u4").tolist() == [300, *[i * 3 % 50 for i in range(300)]]
    edges = spark.createDataFrame([(i, r, (i + r) % 300) for i in range(300) for r in (2, 1)], "src long, rank long, dst long")
    B.write_graph(edges, f"{tmp_path}/g")
    assert np.fromfile(f"{tmp_path}/g", "<u4").tolist() == [300, 2, *[x % 300 for i in range(300) for x in (i + 1, i + 2)]]
    B.write_numbers(p.limit(0), f"{tmp_path}/none", "a0")
    assert np.fromfile(f"{tmp_path}/none", "<u4").tolist() == [0]
    with pytest.raises(ValueError, match="as many in each"):
        B.write_fvecs(p.withColumn("vec", F.slice("vec", 1, F.when(F.col("id") == 9, 2).otherwise(3))), f"{tmp_path}/bad")
    assert not list(tmp_path.glob("*.parts")) or not mounted


def test_half_precision_gives_exact_answers(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(size=6) * 1e-4], 0, 0) for i in range(400)] + [(500, None, 0, 0), (501, [1e4] * 6, 0, 0)]  # many closer to one another than two bytes tell
    p = spark.createDataFrame(rows, "id long, vec array<double>, a0 long, a1 long")
    q = p.filter("id < 30").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), *[F.lit(None).cast("long").alias(c) for c in ("l0", "r0", "l1", "r1")])
    halves = V.halved(p).cache()
    assert {len(r["half"]) for r in halves.filter("half IS NOT NULL").collect()} == {12} and halves.filter("gap IS NULL").count() == 1
    assert ids(Q.from_halves(halves, p, q, 5, block=8)) == ids(Q.exact_blocks(p, q, 0, 5))
    rough = Q.exact_blocks(halves.select("id", F.col("half").alias("vec")), q, 0, 5)
    assert ids(rough) != ids(Q.exact_blocks(p, q, 0, 5))  # halves alone are not enough
    with pytest.raises(Exception, match="two bytes"):
        V.halved(p.withColumn("vec", F.array(F.lit(1e5)))).count()
