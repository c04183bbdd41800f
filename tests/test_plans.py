"""Selectivity by bounds, blocks of many queries, and batches of cells that are visited together."""

import random

import pytest
from pyspark.sql import functions as F

from veldspar.functions import predicates as P
from veldspar.operators import grid as R
from veldspar.operators import search as Q
from veldspar.plans import selection as S
from tests.test_engine import QUERIES, asked, ids, points, small


@pytest.fixture
def few_at_once(monkeypatch):
    """Queries fit a broadcast only by three."""
    from veldspar.functions import sizes

    monkeypatch.setattr(sizes.fits, "__defaults__", (3, 1 << 20))
    monkeypatch.setattr(sizes.in_blocks, "__defaults__", (3,))


def boxes(spark, n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = sorted(r.randint(-1, 7) for _ in range(2))
        c, d = sorted(r.randint(-5, 105) for _ in range(2))
        rows.append((i, [r.gauss(0, 1) for _ in range(4)], r.choice([a, None]), b, c, r.choice([d, None])))
    return asked(spark, *rows)


def test_many_queries_go_in_blocks_and_never_meet_all_points(spark, few_at_once):
    p, q = small(spark).cache(), boxes(spark, 10).cache()
    for df in (S.selectivity(p, q, P.box(2)), Q.chunk_merged(p, q, 2, 4, 3)):
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    want = {x["qid"]: sum(all((x[f"l{j}"] is None or a >= x[f"l{j}"]) and (x[f"r{j}"] is None or a <= x[f"r{j}"]) for j, a in enumerate((y["a0"], y["a1"]))) for y in p.collect()) for x in q.collect()}
    assert {r["qid"]: r["matches"] for r in S.selectivity(p, q, P.box(2)).collect()} == want
    assert ids(Q.chunk_merged(p, q, 2, 4, 3)) == ids(Q.exact_blocks(p, q, 2, 4))


def test_seventy_thousand_queries_plan_no_product(spark):
    p = small(spark, 5)
    i = F.col("id")
    q = spark.range(70000).select(i.alias("qid"), F.array(*[F.lit(0.0)] * 4).cast("array<float>").alias("qvec"), *[(i % 7).alias(c) for c in ("l0", "r0", "l1", "r1")])
    plan = S.selectivity(p, q, P.box(2))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" in plan


def test_bounds_hold_and_choose_as_counting_does(spark):
    g = R.equi_depth(small(spark, 300), [3, 4]).cache()
    q, cells = boxes(spark, 60, 2).cache(), R.cell_boxes(g, 2).cache()
    true = {r["qid"]: (r["matches"], r["selectivity"]) for r in S.selectivity(g, q, P.box(2)).collect()}
    for r in S.estimated_selectivity(q, cells, 2).collect():
        assert r["least"] <= true[r["qid"]][0] <= r["most"] and r["least"] <= r["estimate"] + 1e-9 and r["estimate"] <= r["most"] + 1e-9
    for threshold in (0.0, 0.02, 0.1, 0.5, 1.0):
        got = S.selectivity_by_estimate(g, q, cells, 2, P.box(2), threshold).collect()
        assert {r["qid"]: r["selectivity"] <= threshold for r in got} == {i: s <= threshold for i, (_, s) in true.items()}
    counted = sum(r["exact"] for r in S.selectivity_by_estimate(g, q, cells, 2, P.box(2), 0.02).collect())
    assert 0 < counted < 60


def plain_batches(visits, size, budget):
    """Cells one at a time: the most visited first, then what shares most visits with the batch."""
    left, out = set(size), []
    while left:
        batch = [min(left, key=lambda c: (-sum(c in v for v in visits.values()), c))]
        while True:
            share = {c: sum((c in v) * sum(b in v for b in batch) for v in visits.values()) for c in left - set(batch) if sum(size[b] for b in batch) + size[c] <= budget}
            share = {c: n for c, n in share.items() if n}
            if not share:
                break
            batch.append(min(share, key=lambda c: (-share[c], c)))
        out.append(batch)
        left -= set(batch)
    return {c: i for i, batch in enumerate(out) for c in batch}


def test_batches_by_visits_match_plain_packing_and_save_visits(spark):
    r = random.Random(5)
    kinds = [r.sample(range(24), 5) for _ in range(4)]
    visits = {q: set(r.choice(kinds)) | set(r.sample(range(24), 1)) for q in range(80)}
    size = {c: r.randint(1, 9) for c in range(26)}
    chosen = spark.createDataFrame([(q, c) for q, v in visits.items() for c in v], "qid long, cell_id long")
    cells = spark.createDataFrame(list(size.items()), "cell_id long, n long")
    got = {x["cell_id"]: x["batch_id"] for x in S.batches_by_visits(chosen, cells, 30).collect()}
    assert got == plain_batches(visits, size, 30)
    by_order = S.batches(cells, 5)
    by_visits = S.batches_by_visits(chosen, cells, 30)
    assert S.query_batches(chosen, by_visits).count() < S.query_batches(chosen, by_order).count()
