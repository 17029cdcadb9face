"""Hard negatives and vector codes against plain loops over hostile rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectramesh.llm import hardnegatives as H
from spectramesh.llm import vectorcodes as C

SCHEMA = "vec_id bigint, embedding array<double>, label int, row string, v int, score double, id int"


def hostile(seed=3, n=320, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).tolist(), int(rng.integers(0, 4)), "r", 1, 0.5, 9) for i in range(n)]
    rows += [(n + i, rows[7][1], 1, "copy", 1, 0.5, 9) for i in range(40)]  # ties
    rows += [rows[100], rows[100], rows[3]]  # repeated rows, one of them an anchor
    nan, inf = float("nan"), float("inf")
    rows += [(None, rows[0][1], 0, "", 0, 0.0, 0), (1000, None, 0, "", 0, 0.0, 0), (1100, [nan] * dim, 0, "", 0, 0.0, 0), (1200, [inf] + [0.0] * (dim - 1), 0, "", 0, 0.0, 0), (1300, [None] + [1.0] * (dim - 1), 1, "", 0, 0.0, 0)]
    rows += [(1400, [0.0] * dim, 2, "", 0, 0.0, 0), (1500, rows[1][1], None, "", 0, 0.0, 0), (1600, [1e30] * dim, 3, "", 0, 0.0, 0)]
    return rows


def whole(v, scale):
    return np.clip(np.floor(np.array(v, float) * scale), -(1 << 26), 1 << 26).astype(np.int64)


def brute_negatives(rows, k=5, m=10):
    ok = [(i, lab, whole(v, 256)) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for a, (ai, alab, av) in enumerate(ok):
        if ai % 100:
            continue
        scored = sorted((-int(av @ v), i, c, lab) for c, (i, lab, v) in enumerate(ok) if c != a and len(v) == len(av))
        for s, i, _, _ in [x for x in scored if x[3] == alab][:k]:
            fit = [x for x in scored if x[3] != alab and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out += [(ai, i, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block_rows, anchor_rows", [(8192, 4096), (50, 2)])
def test_hard_negatives(spark, block_rows, anchor_rows):
    rows = hostile() + [(1700, [1.0, 2.0], 0, "short", 0, 0.0, 0), (1701, [2.0, 1.0], 0, "", 0, 0.0, 0), (1702, [1.0, 0.5], 1, "", 0, 0.0, 0)]
    got = H.mine(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0, block_rows=block_rows, anchor_rows=anchor_rows)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert H.mine(none, F.col("vec_id") % 100 == 0).collect() == []
    assert C.code_vectors(none).collect() == []
    only = spark.createDataFrame([(100, [1.0] * 8, None, "", 0, 0.0, 0), (5, None, 1, "", 0, 0.0, 0)], SCHEMA)
    assert H.mine(only, F.col("vec_id") % 100 == 0).collect() == []
    assert [r.code for r in C.code_vectors(only).collect()] == ["00000000"]


def test_planes_and_intervals():
    """Planes add up to the numbers; every interval holds the score; pairs are dropped long before the last plane."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-150, 150, (3000, 64)), np.zeros((1, 64), np.int64), np.full((1, 64), -(1 << 26))])
    slices, weights = H.planes(x)
    assert (sum(w * s.astype(np.int64) for s, w in zip(slices, weights)) == x).all()
    x, a = x[:3000], rng.integers(-150, 150, (20, 64))
    slices, weights = H.planes(x)
    pairs, real = H.Pairs(a, slices, weights, np.ones((20, 3000), bool)), a @ x.T

    def qualify(group, low, high):
        s = real[group, pairs.row]
        assert (low <= s).all() and (s <= high).all()
        return high >= H.kth(group, low, 5, 20)[group]

    pairs.run(qualify)
    assert (pairs.score == real[pairs.anchor, pairs.row]).all()
    assert pairs.taken < 0.75 * 20 * 3000 * len(slices)
    for g in range(20):
        assert set(np.argsort(-real[g], kind="stable")[:5]) <= set(pairs.row[pairs.anchor == g])


def brute_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    ok = [(i, lab, whole(v, scale)) for i, v, lab, *_ in rows if v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all()]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    dim = len(ok[0][2])
    fit, w = [r for r in ok if len(r[2]) == dim], dim // parts
    books = [[r[2][p * w : (p + 1) * w].tolist() for r in fit[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((int(a) - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for r in range(rounds + 1):
        codes = [[near(v[p * w : (p + 1) * w], books[p]) for p in range(parts)] for _, _, v in fit]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    own = [v[p * w : (p + 1) * w] for (_, _, v), c in zip(fit, codes) if c[p][1] == e]
                    if own:
                        books[p][e] = [int(s) // len(own) for s in np.sum(own, axis=0)]
    error = {k: sum(d for d, _ in c) for k, c in enumerate(codes)}
    by = {}
    for k, (_, lab, _) in enumerate(fit):
        by[lab] = by.get(lab, 0) + error[k]
    digest = hashlib.sha256(",".join(str(y) for b in books for c in b for y in c).encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for _, e in codes[k]), error[k], by[lab], digest) for k, (i, lab, _) in enumerate(fit)]
    return sorted(out + [(i, None, None, by.get(lab), digest) for i, lab, v in ok if len(v) != dim], key=repr)


def test_vector_codes(spark):
    rows = hostile(dim=8) + [(1700, [1.0, 2.0], 0, "short", 0, 0.0, 0)]
    got = C.code_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows)


def test_few_entries_and_bad_cut(spark):
    rows = [(i, [float(i % 3), 1.0, 2.0, float(-i)], i % 2, "", 0, 0.0, 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = C.code_vectors(df, entries=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_codes(rows, entries=4)
    with pytest.raises(ValueError):
        C.compress(df, parts=3)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (100, 1 << 26):
        a, b = rng.integers(-size, size, (50, 16)), rng.integers(-size, size, (30, 16))
        assert (C.products(a, b) == np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a])).all()
    x = rng.integers(-500, 500, (300, 8))
    coded, _ = C.assign(x, books := np.stack([x[:20, :4], x[:20, 4:]]))
    assert (C.decode(coded[:20], books) == x[:20]).all()
