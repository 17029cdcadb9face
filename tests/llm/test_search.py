"""Vantage-point trees and the license scan against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectramesh.llm import licenses, vptree

VECTORS = "vec_id bigint, embedding array<float>, label int, score string"


def brute(rows, k=5):
    ok = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, v in ok:
        if i % 50 == 0:
            near = [(-sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) ** 0.5 * sum(b * b for b in w) ** 0.5), j) for j, w in ok if j != i and len(w) == len(v)]
            out.setdefault(i, [j for _, j in sorted(near)[:k]])
    return out


def asked(df, **kw):
    got = {}
    for r in vptree.nearest(df, F.col("vec_id") % 50 == 0, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


@pytest.mark.parametrize("shard_rows, block_rows", [(8192, 4096), (60, 3)])
def test_exact_with_factor_one(spark, shard_rows, block_rows):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("f4").tolist(), 0, "") for i in range(500)]
    rows += [(500 + i, rows[3][1], 0, "") for i in range(40)]  # copies: ties
    rows += [(600, None, 0, ""), (650, [0.0] * 8, 0, ""), (700, [1.0, None] + [0.0] * 6, 0, ""), (750, [float("nan")] * 8, 0, ""), (800, [float("inf")] + [1.0] * 7, 0, ""), (None, rows[0][1], 0, ""), (850, [1.0, 2.0], 0, ""), (851, [2.0, 1.0], 0, "")]
    assert asked(spark.createDataFrame(rows, VECTORS), shard_rows=shard_rows, block_rows=block_rows, factor=1.0) == brute(rows)


def test_recall_of_a_relaxed_search(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    assert asked(df, factor=1.0) == want
    got = asked(df)
    assert np.mean([len(set(got[q]) & set(w)) / 5 for q, w in want.items()]) >= 0.95


def shapes(n=9000, d=64):
    """Vectors that trees can tell apart, and vectors that they can't."""
    rng = np.random.default_rng(7)
    x, centres = rng.normal(size=(n, d)), rng.normal(size=(40, d)) * 3
    return {
        "alike in all directions": (x, None),
        "far from the origin": (x + 2, None),
        "falling spectrum": (x * np.arange(1, d + 1) ** -0.5, 0.5),
        "steep spectrum": (x / np.arange(1, d + 1), 0.5),
        "few dimensions": (rng.normal(size=(n, 8)) @ rng.normal(size=(8, d)) + 0.01 * x, 0.5),
        "few dimensions, far away": (rng.normal(size=(n, 4)) @ rng.normal(size=(4, d)) + 1, 0.5),
        "clusters": (centres[rng.integers(0, 40, n)] + x, 0.2),
        "tight clusters": (centres[rng.integers(0, 40, n)] + 0.3 * x, 0.2),
    }


@pytest.mark.parametrize("kind", sorted(shapes(60)))
def test_pruning_and_recall(kind):
    """A tree's own factor keeps the neighbours and leaves out most pairs where the vectors allow that; else it is one. Factor one is exact."""
    x, most = shapes()[kind]
    n = len(x)
    ids, q = np.arange(n), np.arange(0, n, 50)
    tree = vptree.Tree(ids, x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit[q] @ unit.T
    s[np.arange(len(q)), q] = -9
    want = np.argsort(-s, axis=1)[:, :5]
    assert (tree.factor == 1.0) == (most is None)
    for factor, least in ((None, 0.95), (1.0, 1.0)):
        search = vptree.Search(vptree.Tree.from_bytes(tree.to_bytes()), ids[q], x[q], 5, factor)
        found = {}
        for a, b, _ in zip(*search.found(), strict=True):
            found.setdefault(a, set()).add(b)
        assert np.mean([len(found[a] & set(w)) / 5 for a, w in zip(ids[q], want)]) >= least
        if factor is None:
            assert search.scored + search.bounds <= (most or 1.01) * len(q) * n


def test_bounds_leave_out_nothing_at_factor_one():
    """No leaf is farther by its gap than any of its vectors is."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6))
    x[100:130] = x[5] * np.linspace(1, 2, 30)[:, None]
    x[200:900] = x[7]
    tree = vptree.Tree(np.arange(3000), x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    real, gaps = np.linalg.norm(unit[:200, None] - tree.unit[None], axis=2), tree.gaps(unit[:200])
    for leaf, (a, b) in enumerate(zip(tree.starts, tree.starts[1:])):
        assert (gaps[:, leaf] <= real[:, a:b].min(1) + 1e-6).all()
    assert sorted(tree.ids) == list(range(3000)) and gaps.max() > 0.3


def test_scores_and_edges(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, ""), (1, [1.0, 1.0], 0, ""), (0, [0.0, 1.0], 0, "")], VECTORS)
    got = vptree.nearest(df, F.col("vec_id") % 50 == 0).collect()
    assert {r.vec_id for r in got} == {1} and all(abs(r.score - 0.5**0.5) < 1e-15 for r in got)
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tiny_and_huge_vectors(spark):
    """Squares that underflow or overflow lose no vector, and near scores are ordered as they are."""
    rows = [(0, [1e-300, 1e-300]), (1, [1e200, 1e200]), (2, [1.0, 1.0 + 1e-13]), (50, [5e-324, 0.0]), (3, [1.0, 0.0]), (4, [1.0, 1.0 + 1e-7])]
    got = asked(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert got[0] == [1, 2, 4, 3, 50] and got[50][:1] == [3]


DOCS = "doc_id bigint, text string, license string, template int"


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def contains(text, template, similarity=0.8):
    a, b = words(text), words(template)
    n = min(licenses.WORDS, len(b))
    s = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    size = len(b) - n + 1
    spots = [tuple(a[i : i + n]) for i in range(len(a) - n + 1)]
    return any(len(s & set(spots[i : i + size])) / len(s) >= similarity for i in range(max(1, len(spots) - size + 1)))


def test_scan_against_brute_force(spark):
    rng = random.Random(5)
    vocab = words(" ".join(t for _, t in licenses.TEMPLATES)) + [f"n{i}" for i in range(300)]
    texts = [None, "", "mit", licenses.TEMPLATES[0][1].upper()]
    for k in range(120):
        w = words(licenses.TEMPLATES[k % len(licenses.TEMPLATES)][1])
        for _ in range(rng.choice([0, 0, 1, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        fill = rng.choices(vocab, k=rng.choice([0, 20, 900]))
        at = rng.randrange(len(fill) + 1)
        texts.append(" ".join(fill[:at]) + "\n" + ", ".join(w) + ". " + " ".join(fill[at:]))
    df = spark.createDataFrame([(i, t, "?", 0) for i, t in enumerate(texts)], DOCS)
    got = {(r.doc_id, r.template) for r in licenses.scan_documents(df).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, (_, u) in enumerate(licenses.TEMPLATES) if contains(t, u)}
    assert got == want and len(want) > 80


def test_scan_edges(spark):
    text = "Intro.\n" + licenses.TEMPLATES[4][1] + " More.\n" + licenses.TEMPLATES[4][1]
    df = spark.createDataFrame([(1, text, "", 0), (1, text, "", 0), (None, text, "", 0), (2, "filler " * 100_000 + licenses.TEMPLATES[2][1], "", 0)], DOCS)
    got = licenses.scan_documents(df).collect()
    assert sorted((r.doc_id or 0, r.license, r.first_word) for r in got) == [(0, "GPL-3.0", 1), (1, "GPL-3.0", 1), (1, "GPL-3.0", 1), (2, "MIT", 100_000)]
    assert licenses.scan_documents(df.limit(0)).count() == 0


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("B", "one two three four five six seven"), ("A", "all rights of this sort stay"), (None, "x"), ("C", None), ("A", "all rights of this sort stay")], "license string, text string")
    df = spark.createDataFrame([(1, "so all rights of this sort stay here"), (2, "zero one two three four five six seven eight")], "doc_id bigint, text string")
    assert licenses.listed(table) == (("A", "all rights of this sort stay"), ("B", "one two three four five six seven"))
    assert sorted((r.doc_id, r.license, r.template, r.first_word) for r in licenses.scan_documents(df, table).collect()) == [(1, "A", 0, 1), (2, "B", 1, 1)]
    assert licenses.scan_documents(df, table.limit(0)).count() == 0


def test_a_notice_is_nearest_to_its_own_template(spark):
    df = spark.createDataFrame([(i, "Note. " + t + " End.") for i, (_, t) in enumerate(licenses.TEMPLATES)], "doc_id bigint, text string")
    best = {}
    for r in licenses.scan_documents(df).collect():
        best.setdefault(r.doc_id, []).append((-r.containment, r.template != r.doc_id, r.license))
    assert [min(best[i])[2] for i in range(len(licenses.TEMPLATES))] == [n for n, _ in licenses.TEMPLATES] and all(min(x)[0] == -1 for x in best.values())
