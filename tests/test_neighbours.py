"""Neighbours of long vectors: blocks searched both ways, copies, vectors that single precision or few steps can't tell apart."""

import math

import numpy as np
import pytest

from spectramesh.operators import blocks, embedding, information


def tables():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 12))
    yield x
    yield x + 1e6
    yield np.where(np.arange(400)[:, None] == 5, x * 1e12, x)
    yield np.where(np.arange(400)[:, None] % 2 == 0, x[0], np.round(x, 0))
    yield np.where((np.arange(400)[:, None] == 7) & (np.arange(12) == 2), np.inf, x)


def plainly(x, ids, k, metric):
    with np.errstate(all="ignore"):
        d = blocks._exact(x[:, None], x[None], metric)
    d[ids[:, None] == ids[None]] = np.nan
    return [(int(ids[r]), int(ids[s]), float(d[r, s])) for r in range(len(x)) for s in np.lexsort((ids, d[r]))[:k] if not np.isnan(d[r, s])]


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_searches_are_exact(metric):
    for x in tables():
        ids = np.random.default_rng(2).permutation(len(x))
        i, j, d = blocks._search(x, ids, x, ids, 4, metric)
        assert sorted(zip(ids[i].tolist(), ids[j].tolist(), d.tolist(), strict=True)) == sorted(plainly(x, ids, 4, metric))


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_copies_are_measured_once(monkeypatch, metric):
    """Three thousand copies beside a thousand others: no pair of copies is measured by itself."""
    rng = np.random.default_rng(3)
    x = np.vstack([np.repeat(rng.normal(size=(1, 16)), 3000, 0), rng.normal(size=(1000, 16))])
    kept, measured = blocks._exact, []
    monkeypatch.setattr(blocks, "_exact", lambda a, b, m: measured.append(math.prod(np.broadcast_shapes(a.shape, b.shape)[:-1])) or kept(a, b, m))
    i, j, _ = blocks._search(x, np.arange(4000), x, np.arange(4000), 3, metric)
    assert len(i) == 12_000 and j[i == 2999].tolist() == [0, 1, 2] and sum(measured) < 200_000


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_each_pair_of_blocks_is_met_once(spark, metric):
    """Rows are sent to as many places as there are blocks, not to twice as many; small groups of long vectors go the same way."""
    x = np.round(np.random.default_rng(4).normal(size=(90, 5)), 1)
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)] + [("a", 900, None), ("a", 901, [math.nan] * 5)], "g string, i long, x array<double>")
    found = blocks.nearest(df, "g", "i", "x", 3, metric, least=20, most=20)
    want = sorted(plainly(x, np.arange(90), 3, metric))
    for rows in (found, information.neighbours(df, "g", "i", "x", 3, metric)):
        assert "CoGroup" not in rows._jdf.queryExecution().toString() and "FlatMapGroupsInArrow" in rows._jdf.queryExecution().toString()
        assert sorted((r.i, r.j, r.d) for r in rows.collect()) == want


def test_graph_is_weighed_in_arrow_batches(spark):
    """Memberships add up to log2(k); equal points have one; weights come from lists of neighbours, without a row per step of halving."""
    x = np.random.default_rng(6).normal(size=(80, 6))
    x[40:45] = x[40]
    found = embedding.fuzzy_graph(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"), 8)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "lambdafunction(exp" not in plan.lower()
    got = {(r.i, r.j): r.w for r in found.collect()}
    w, pairs = np.zeros((80, 80)), set()
    for i in range(80):
        mine = [(j, d) for a, j, d in plainly(x, np.arange(80), 8, "euclidean") if a == i]
        rho = min(d for _, d in mine if d > 0)
        e = [max(0.0, d - rho) for _, d in mine]
        low, high, mid = 0.0, math.inf, 1.0
        for _ in range(64):
            low, high = (low, mid) if sum(math.exp(-v / mid) for v in e) > 3 else (mid, high)
            mid = low * 2 if math.isinf(high) else (low + high) / 2
        pairs |= {(min(i, j), max(i, j)) for j, _ in mine}
        w[i, [j for j, _ in mine]] = [math.exp(-v / mid) for v in e]
    both = w + w.T - w * w.T
    assert got.keys() == pairs
    assert all(abs(both[k] - v) < 1e-9 for k, v in got.items())
