"""Beams of bounded width that go from cell to cell, against a plain walk over lists and dictionaries."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar import catalog
from veldspar.operators import cells as W
from veldspar.operators import graph as G
from veldspar.operators.parts import dealt
from veldspar.plans import selection as S

SF = "/root/testdata/sf0.01"


class World:
    """Everything of the small tables in plain dictionaries."""

    def __init__(self, spark):
        plan = catalog.Plan(spark, SF, "mixed")
        self.edges, self.cross = plan.graphs()
        self.plan, self.order = plan, plan.order()
        self.index = W.write_index(plan.grid, self.edges, self.cross, 2)
        grid = plan.grid.collect()
        self.vec = {r["id"]: np.array(r["vec"], np.float64) for r in grid}
        self.attributes = {r["id"]: (r["a0"], r["a1"]) for r in grid}
        self.members = {}
        for r in sorted(grid, key=lambda r: r["id"]):
            self.members.setdefault(r["cell_id"], []).append(r["id"])
        self.near, self.far = {}, {}
        for r in self.edges.orderBy("rank").collect():
            self.near.setdefault(r["src"], []).append(r["dst"])
        for r in self.cross.orderBy("rank").collect():
            self.far.setdefault((r["src"], r["dst_cell"]), []).append(r["dst"])
        self.queries = {r["qid"]: r for r in plan.queries.collect()}
        self.visits = {}
        for r in self.order.orderBy("visit_rank").collect():
            self.visits.setdefault(r["qid"], []).append(r["cell_id"])


@pytest.fixture(scope="module")
def world(spark):
    return World(spark)


class Plain:
    """One query's walk."""

    def __init__(self, world, qid, width, recycle):
        self.w, self.q, self.width, self.recycle = world, world.queries[qid], width, recycle
        self.beam, self.spare, self.met, self.expanded = [], [], set(), set()
        self.counts = [0, 0, 0]

    def distance(self, i):
        d = self.w.vec[i] - np.array(self.q["qvec"], np.float64)
        return float(sum(d * d))

    def inside(self, i):
        return all(self.q[f"l{j}"] <= a <= self.q[f"r{j}"] for j, a in enumerate(self.w.attributes[i]))

    def offer(self, points):
        new = [i for i in dict.fromkeys(points) if i not in self.met]
        self.met |= set(new)
        self.counts[2] += len(new)
        every = sorted(self.beam + [(self.distance(i), i) for i in new])
        self.beam = every[: self.width]
        self.spare = sorted(self.spare + [x for x in every[self.width :] if self.inside(x[1])])[: self.recycle]

    def scattered(self, cell):
        m = self.w.members[cell]
        return [m[j * (len(m) - 1) // 15] for j in range(16)]

    def enter(self, cell, hops=True, of=None):
        """Over the cross edges of the beam's points, those of the cells `of` only."""
        known = set(self.w.vec) if of is None else {i for c in of for i in self.w.members[c]}
        ways = [t for _, i in self.beam[:64] if i in known for t in self.w.far.get((i, cell), [])[:2]] if hops else []
        self.counts[0] += 1
        self.offer(ways or self.scattered(cell))

    def open(self, cell):
        return next((i for _, i in self.beam if i not in self.expanded and i in self.w.members[cell]), None)

    def expand(self, i):
        self.expanded.add(i)
        self.counts[1] += 1
        self.offer(self.w.near[i])

    def answer(self, k):
        return [i for _, i in sorted([x for x in self.beam if self.inside(x[1])] + self.spare)[:k]]


def one_channel(world, qid, width, recycle, groups=None):
    walk = Plain(world, qid, width, recycle)
    cells = world.visits[qid]
    for group in groups or [cells]:
        for n, cell in enumerate([c for c in cells if c in group]):
            walk.enter(cell, hops=n > 0, of=group)
            while (i := walk.open(cell)) is not None:
                walk.expand(i)
    return walk


def two_channels(world, qid, width, recycle):
    walk = Plain(world, qid, width, recycle)
    cells = list(world.visits[qid])
    at, turn = cells[:2], 0
    del cells[:2]
    for cell in at:
        walk.enter(cell, hops=False)
    while at:
        i = walk.open(at[turn])
        if i is None:
            if cells:
                at[turn] = cells.pop(0)
                walk.enter(at[turn])
            else:
                at.pop(turn)
                turn = 0
            continue
        walk.expand(i)
        if len(at) == 2:
            turn = 1 - turn
            fresh = [t for t in world.far.get((i, at[turn]), [])[:2] if t not in walk.met]
            if fresh:
                walk.expanded.add(fresh[0])
                walk.offer(fresh[:1])
                walk.expand(fresh[0])
    return walk


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


@pytest.mark.parametrize("width,recycle", [(4, 3), (12, 1), (24, 10), (1000, 10)])
def test_one_channel_is_the_plain_walk(world, width, recycle):
    states = W.walk(world.index, world.plan.queries, world.order, width=width, recycle=recycle)
    plain = {q: one_channel(world, q, width, recycle) for q in world.visits}
    assert found(W.answers(states, 10)) == {q: a for q, p in plain.items() if (a := p.answer(10))}
    assert {r["qid"]: [r["cells"], r["hops"], r["scored"]] for r in W.counters(states).collect()} == {q: p.counts for q, p in plain.items()}


def test_a_recycle_list_gives_back_what_narrow_boxes_lose(world):
    narrow = {q for q, r in world.queries.items() if q in world.visits}
    without = sum(len(one_channel(world, q, 4, 0).answer(10)) for q in narrow)
    with_list = sum(len(one_channel(world, q, 4, 10).answer(10)) for q in narrow)
    assert with_list > without
    assert sum(map(len, found(W.search(world.index, world.plan.queries, world.order, 10, width=4, recycle=10)).values())) == with_list


@pytest.mark.parametrize("width", [6, 20])
def test_two_channels_are_the_plain_walk(world, width):
    states = W.walk_two(world.index, world.plan.queries, world.order, width=width, recycle=5)
    plain = {q: two_channels(world, q, width, 5) for q in world.visits}
    assert found(W.answers(states, 10)) == {q: a for q, p in plain.items() if (a := p.answer(10))}
    assert {r["qid"]: [r["cells"], r["hops"], r["scored"]] for r in W.counters(states).collect()} == {q: p.counts for q, p in plain.items()}


def test_batches_carry_the_beam_and_read_only_their_cells(spark, world, monkeypatch):
    batches = S.batches(world.plan.cells, 5)
    groups = {}
    for r in batches.collect():
        groups.setdefault(r["batch_id"], set()).add(r["cell_id"])
    monkeypatch.setattr(W, "VISITS", 2)  # a cell's states in several tasks
    reach, real = [], W._round
    monkeypatch.setattr(W, "_round", lambda index, states, places, cells, *more: (reach.append(set(cells)), real(index, states, places, cells, *more))[1])
    ordered = world.order.join(batches, "cell_id")
    got = found(W.search(world.index, world.plan.queries, ordered, 10, width=8, recycle=4))
    plain = {q: one_channel(world, q, 8, 4, [groups[b] for b in sorted(groups)]) for q in world.visits}
    assert got == {q: a for q, p in plain.items() if (a := p.answer(10))}
    assert all(any(cells <= g for g in groups.values()) for cells in reach)  # no round asks for a cell or cross edge of another batch


def test_the_index_is_read_by_partition(spark, world):
    own = world.index.cells(spark).filter(F.col("cell_id").isin([3, 5]))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "cell_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["cell_id"] for r in own.select("cell_id").collect()} == {3, 5}


def test_a_wide_beam_finds_what_exact_search_finds(world):
    from veldspar.operators import evaluate as E
    from veldspar.operators import search as Q

    truth = Q.exact(world.plan.grid, world.plan.queries, 2, 10)
    for channels in (1, 2):
        got = W.search(world.index, world.plan.queries, world.order, 10, width=64, recycle=64, channels=channels)
        assert E.recall(got, truth, world.plan.queries).first()["recall"] >= 0.9


def test_cross_edges_by_search_are_plain_walks(world):
    got = {}
    for r in W.cross_edges_by_search(world.index, world.plan.grid, 2, width=18, tasks=40).orderBy("rank").collect():
        got.setdefault((r["src"], r["dst_cell"]), []).append(r["dst"])
    assert len(got) == len(world.vec) * len(world.members)
    world.queries["point"] = {"l0": 0, "r0": 0, "l1": 0, "r1": 0}
    for (src, cell), found in sorted(got.items())[::37]:
        world.queries["point"]["qvec"] = world.vec[src]
        walk = Plain(world, "point", 18, 0)
        walk.offer(world.members[cell] if len(world.members[cell]) <= 18 else walk.scattered(cell))
        while (i := walk.open(cell)) is not None:
            walk.expand(i)
        assert found == [i for _, i in walk.beam if i != src][:2]
    exact = {}
    for r in world.cross.orderBy("rank").collect():
        exact.setdefault((r["src"], r["dst_cell"]), []).append(r["dst"])
    hits = sum(len(set(exact[key]) & set(found)) for key, found in got.items())
    assert hits >= 0.9 * sum(map(len, exact.values()))
    del world.queries["point"]


def test_an_index_with_searched_cross_edges_finds_neighbours(world):
    from veldspar.operators import evaluate as E
    from veldspar.operators import search as Q

    index = W.write_index(world.plan.grid, world.edges, None, 2, width=24)
    got = W.search(index, world.plan.queries, world.order, 10, width=48, recycle=48)
    assert E.recall(got, Q.exact(world.plan.grid, world.plan.queries, 2, 10), world.plan.queries).first()["recall"] >= 0.9


def test_descent_finds_neighbours_of_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 24))[rng.integers(0, 40, 4000)] * 0.5 + rng.normal(size=(4000, 24))
    near, dist = G.neighbours_by_descent(x, 24)
    d = ((x[:300, None] - x[None]) ** 2).sum(2)
    d[np.arange(300), np.arange(300)] = np.inf
    true = np.argsort(d, axis=1)[:, :16]
    assert np.mean([len(set(a[:16]) & set(b)) / 16 for a, b in zip(near[:300].tolist(), true.tolist())]) >= 0.95
    assert (np.diff(dist, axis=1) >= 0).all() and all(len(set(r)) == 24 for r in near.tolist()) and not (near == np.arange(4000)[:, None]).any()
    assert np.allclose(dist[:300], np.take_along_axis(((x[:300, None] - x[None]) ** 2).sum(2), near[:300], 1))


def test_pruning_counts_detours_and_gives_edges_back():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :12]
    lists = near.tolist()
    forward = []
    for u in range(60):
        detours = [sum(lists[u][r] in lists[w][:r] for w in lists[u][:r]) for r in range(12)]
        forward.append([lists[u][r] for r in sorted(range(12), key=lambda r: (detours[r], r))][:6])
    for u in range(60):
        back = [v for r in range(6) for v in range(60) if forward[v][r] == u][:6]
        assert [v for v in G.pruned(near, 6)[u].tolist() if v >= 0] == list(dict.fromkeys(forward[u][:3] + back + forward[u][3:]))[:6]


def test_descended_and_pruned_cells(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=6)], i % 3) for i in range(600)] + [(1000, [0.0] * 6, 9), (1001, [1.0] * 6, None)]
    p = spark.createDataFrame(rows, "id long, vec array<double>, cell_id long")
    exact = {(r["src"], r["dst"]) for r in G.cell_graph(p, 8).collect()}
    found = G.descend(p, 8).collect()
    assert len({(r["src"], r["dst"]) for r in found} & exact) >= 0.97 * len(exact) and len(found) == len(exact)
    cut = G.descend(p, 8, prune=True).collect()
    assert {r["src"] for r in cut} == {r[0] for r in rows[:600]} and max(r["rank"] for r in cut) == 8


def test_cells_larger_than_a_task_are_dealt_into_parts(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 2
    rows = [(i, [float(v) for v in centres[i % 12] + rng.normal(size=8)], 7) for i in range(1500)]
    rows += [(5000 + i, [1.0] * 8, 8) for i in range(300)] + [(9000 + i, [float(i)] * 8, 9) for i in range(40)]
    p = spark.createDataFrame(rows, "id long, vec array<double>, cell_id long")
    parts = dealt(p, 200, overlap=0.12).collect()
    sizes = Counter((r["cell_id"], r["part"]) for r in parts)
    assert max(sizes.values()) <= 200 and sizes[9, ""] == 40
    assert {(r["cell_id"], r["id"]) for r in parts} == {(r[2], r[0]) for r in rows}
    assert len(parts) < 4 * len(rows)
    copies = [r for r in parts if r["cell_id"] == 8]
    assert len(copies) == 300  # equal points are dealt by hash, once each
    exact = {(r["src"], r["dst"]) for r in G.cell_graph(p.filter("cell_id <> 8"), 8).collect()}
    found = G.descend(p, 8, task_points=200, overlap=0.12).collect()
    ranks = Counter(r["src"] for r in found)
    assert set(ranks) == {r[0] for r in rows} and set(ranks.values()) == {8}
    assert len({(r["src"], r["dst"], r["rank"]) for r in found}) == len({(r["src"], r["dst"]) for r in found}) == len(found)
    assert len({(r["src"], r["dst"]) for r in found if r["cell_id"] != 8} & exact) >= 0.9 * len(exact)
    near = {r[0]: np.array(r[1]) for r in rows}
    by_src = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by_src.setdefault(r["src"], []).append(((near[r["src"]] - near[r["dst"]]) ** 2).sum())
    assert all(np.all(np.diff(d) >= -1e-9) for d in by_src.values())
    cut = G.descend(p, 8, prune=True, task_points=200, overlap=0.12).collect()
    assert {r["src"] for r in cut} == {r[0] for r in rows} and max(r["rank"] for r in cut) == 8
    with pytest.raises(ValueError):
        dealt(p, 1)
