"""Work and memory that grow with the input and no faster."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tests.test_engine import asked, ids, points, small
from veldspar import catalog
from veldspar.functions import vectors as V
from veldspar.operators import cells as beams
from veldspar.operators import graph as G
from veldspar.operators import grid as R
from veldspar.operators import search as Q
from veldspar.operators.parts import merge_into, merged
from veldspar.sources import binary as B


def many(spark, n=80):
    return asked(spark, *[(i, [i / n, 0.0, -i / n, 1.0], None if i % 3 else 1, 4, 5, 90) for i in range(n)])


def test_many_queries_are_no_join_of_all_pairs(spark):
    p, q = small(spark), many(spark)
    found = Q.exact(p, q, 2, 5)
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    some = Q.exact(p, q.filter("qid < 60"), 2, 5)
    assert "NestedLoopJoin" in some._jdf.queryExecution().executedPlan().toString()
    assert ids(found.filter("qid < 60")) == ids(some)


def test_lists_of_a_file_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def seen(parts):
        for pdf in parts:
            made.add(len(pdf))
            yield pdf

    truth = Q.exact(small(spark), many(spark, 20), 0, 3).mapInPandas(seen, Q.RESULT)
    B.write_truth(truth, str(tmp_path / "truth"))
    assert made.value == 60
    assert ids(B.read_truth(spark, str(tmp_path / "truth"))) == ids(truth)


def test_a_beam_with_room_for_all_points_walks_the_graph_once_for_all_queries(spark, monkeypatch):
    names = []
    monkeypatch.setattr(Q, "scratch", lambda s, name, make=Q.scratch: names.append(name) or make(s, name))
    p = small(spark)
    edges = spark.createDataFrame([(i, (i + 2) % 60) for i in range(60) if i != 30] + [(4, 77)], "src long, dst long")
    start = spark.createDataFrame([(2,), (99,)], "id long")  # even points up to 30, and ends that are no points
    q = many(spark, 6)
    got = ids(Q.over_graph(p, edges, q, start, 2, 20, width=60))
    assert names == ["led-to"]
    assert got == ids(Q.exact(p.filter("id % 2 = 0 AND id BETWEEN 2 AND 30"), q, 2, 20))
    assert got == ids(Q.over_graph(p, edges, q, start, 2, 20, width=59)) and names[1] == "graph-walk"


def test_endless_beams_reach_what_edges_lead_to(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    adjacency = [rng.integers(0, 300, rng.integers(0, 3)) for _ in range(300)]
    indptr, flat = np.cumsum([0, *map(len, adjacency)]), np.concatenate(adjacency)
    for start in ([0], [5, 9], [299]):
        rows, _, hops = Q.beam(x, np.arange(300), adjacency, x[7], np.array(start), 300, walk=True)
        assert Q.reached_from(indptr, flat, np.array(start)).tolist() == sorted(rows) and hops == len(rows)
    g = R.equi_depth(small(spark, 120), [2, 2])
    edges, cross, q = G.cell_graph(g, 2), G.cross_edges(g, 2), many(spark, 9)
    order = q.select("qid").crossJoin(spark.range(4).select(F.col("id").alias("cell_id"))).withColumn("visit_rank", F.col("cell_id") + 1)
    near, far = (Q.visits_by_cells(g, edges, cross, q, order, 2, 4, width=w, walk=True) for w in (1 << 20, 29))  # cells of 30: a beam of 29 drops one
    assert ids(Q._merge(near.filter("inside"), 4)) == ids(Q._merge(far.filter("inside"), 4))
    counted = {r["qid"]: (r["hops"], r["scored"]) for r in Q.counters(near).collect()}
    assert all(hops == scored for hops, scored in counted.values())


def test_queries_scored_three_at_a_time_come_to_the_driver_together(spark, monkeypatch):
    asked_for = []
    deal = Q._dealt_queries
    monkeypatch.setattr(Q, "_dealt_queries", lambda *of: (asked_for.append(1) or part for part in deal(*of)))
    p, q = small(spark), many(spark)
    for any_ in (False, True):
        want = ids(Q.exact_blocks(p, q, 2, 5, any_=any_))
        assert ids(Q.exact_blocks(p, q, 2, 5, any_=any_, block=3)) == want and len(asked_for) == 2
        monkeypatch.setattr(Q, "QUERY_BLOCK", 20)
        assert ids(Q.exact_blocks(p, q, 2, 5, any_=any_)) == want and len(asked_for) == 6
        monkeypatch.setattr(Q, "QUERY_BLOCK", 4096)
        asked_for.clear()


def test_checked_descent_is_exact(spark):
    rng = np.random.default_rng(6)
    p = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=32)], i % 2) for i in range(1600)], "id long, vec array<double>, cell_id long")
    exact = sorted(map(tuple, G.cell_graph(p, 8).collect()))
    assert sorted(map(tuple, G.descend(p, 8, intermediate=12).collect())) != exact
    assert sorted(map(tuple, G.descend(p, 8, intermediate=12, check=True).collect())) == exact


def test_beams_find_points_that_are_no_neighbours():
    adjacency = [np.array([1]), np.array([0]), np.array([1]), np.array([2])]
    assert [a.tolist() for a in Q._both_ways(adjacency)] == [[1], [0, 2], [1, 3], [2]]


def test_all_pairs_are_no_join_and_equal_the_expressions_bit_for_bit(spark):
    rng = np.random.default_rng(4)
    vecs = [[float(v) for v in rng.normal(size=7)] for _ in range(40)] + [None, [1.0, None], [1.0, 2.0], [], [float("nan")] * 7]
    p = spark.createDataFrame(list(enumerate(vecs)), "id long, vec array<float>").repartition(3)
    q = spark.createDataFrame([(i, v) for i, v in enumerate(vecs[30:])], "qid long, qvec array<float>")
    for by_norms, expression in ((False, V.l2_squared), (True, V.l2_squared_by_norms)):
        want = p.crossJoin(q).select("qid", "id", F.when(V.l2_squared("vec", "qvec").isNotNull(), expression("vec", "qvec")).alias("dist"))  # greatest() skips nulls
        got = Q.every_distance(p, q, by_norms=by_norms)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "Cartesian" not in plan


def test_all_pairs_in_blocks_of_queries(spark, monkeypatch):
    p, q = small(spark), many(spark)
    want = sorted(map(tuple, Q.every_distance(p, q).collect()))
    assert len(want) == 60 * 80
    monkeypatch.setattr(Q, "QUERY_BLOCK", 20)
    monkeypatch.setattr(Q, "PAIRED", 50)
    assert sorted(map(tuple, Q.every_distance(p, q).collect())) == want


def test_distance_queries_compare_by_blocks(spark):
    for name in ("l2_norm_identity", "euclidean_distance"):
        assert "NestedLoopJoin" not in catalog.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()


def test_descent_holds_few_distances_at_a_time():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    tracemalloc.start()
    G.neighbours_by_descent(x, 12, rounds=2)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 200 << 20


def test_pairs_of_a_cell_are_held_few_at_a_time():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(32_000, 4))
    ids = np.arange(len(x)) * 3
    tracemalloc.start()
    row, rank, at = G.nearest_rows(x, ids, x[:1024], 4, ids[:1024])
    assert tracemalloc.get_traced_memory()[1] < 80 << 20  # 1,024 queries' distances to 32,000 points are 250 MB
    tracemalloc.stop()
    assert row.tolist() == np.repeat(np.arange(1024), 4).tolist() and rank.tolist() == [1, 2, 3, 4] * 1024
    for i in range(0, 1024, 100):
        dist = V.exact_distances(x, x[i])
        assert at[row == i].tolist() == [j for j in np.lexsort((ids, dist)).tolist() if j != i][:4]


def test_small_parts_of_a_cell_are_cut_and_merged_in_a_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 2
    rows = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=8)], 7) for i in range(1500)] + [(5000 + i, [1.0] * 8, 8) for i in range(300)]
    p = spark.createDataFrame(rows, "id long, vec array<double>, cell_id long")
    sizes = []
    deal = G.dealt
    monkeypatch.setattr(G, "dealt", lambda points, limit, **how: (sizes.append(limit), out := deal(points, limit, **how))[1])
    exact = {(r["src"], r["dst"]) for r in G.cell_graph(p.filter("cell_id = 7"), 8).collect()}
    for cut_points in (1 << 14, 700):  # no cut between tasks, and some
        monkeypatch.setattr(G, "CUT_POINTS", cut_points)
        found = G.descend(p, 8, task_points=100, overlap=0.15).collect()
        ranks = sorted((r["src"], r["rank"]) for r in found)
        assert ranks == sorted((r[0], k) for r in rows for k in range(1, 9))
        assert len({(r["src"], r["dst"]) for r in found} & exact) >= 0.9 * len(exact)
    assert sizes == [1 << 14, 700]


def test_lists_merged_in_a_task_are_those_merged_between_tasks(spark):
    rng = np.random.default_rng(8)
    for by_rank in (False, True):
        near, dist, rank = np.full((12, 3), -1), np.full((12, 3), np.inf), np.full((12, 3), 15)
        far, rows = rng.permutation(144).reshape(12, 12) + 0.0, []
        for _ in range(5):
            at = np.sort(rng.choice(12, 6, replace=False))
            more = np.array([rng.choice(12, 4, replace=False) for _ in at])
            more[:, 3] = -1
            if not by_rank:
                more[:, :3] = np.take_along_axis(more[:, :3], np.argsort(far[at[:, None], more[:, :3]], axis=1), 1)
            merge_into(near, dist, rank, at, more, far[at[:, None], more], by_rank=by_rank)
            rows += [(0, int(s), j + 1, int(more[i, j]), float(far[s, more[i, j]])) for i, s in enumerate(at) for j in range(3)]
        want = merged(spark.createDataFrame(rows, "cell_id long, src long, rank long, dst long, dist double"), 3, by_rank=by_rank)
        assert sorted((r["src"], r["rank"], r["dst"]) for r in want.collect()) == sorted((s, j + 1, int(near[s, j])) for s in range(12) for j in range(3) if near[s, j] >= 0)


def test_states_in_the_same_two_cells_share_a_place():
    nothing = np.zeros(0)
    states = [beams.State(i, nothing, nothing, nothing, [], [], at=at) for i, at in enumerate(([3, 12], [12, 3], [12]))]
    assert [beams._place(s) for s in states] == ["3,12", "3,12", "12"] and states[1].at == [12, 3]


def test_frontiers_are_not_broadcast(spark):
    frontier = spark.createDataFrame([(1, 5), (2, 5)], "qid long, id long")
    ends = Q._ends(frontier, spark.createDataFrame([(5, 6), (6, 7)], "src long, dst long"))
    assert "BroadcastExchange" not in ends._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, ends.collect())) == [(1, 6), (2, 6)]
