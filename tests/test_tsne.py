"""t-SNE beyond one task: rows of clusters stay together, pushes are those of all pairs, rows without a vector have no place."""

import numpy as np

from spectramesh.kernels import embed
from spectramesh.operators import embedding, tsne


def test_many_rows(spark, monkeypatch):
    """A table over the limit of one task used to raise an error."""
    rng = np.random.default_rng(0)
    label = np.arange(300) % 3
    x = 20 * np.eye(3, 8)[label] + rng.normal(size=(300, 8))
    rows = spark.createDataFrame([("data", i, v.tolist()) for i, v in enumerate(x)] + [("center", 0, None)], "kind string, id long, x array<double>")
    kept = tsne.large
    monkeypatch.setattr(embed, "MOST", 100)
    monkeypatch.setattr(tsne, "MARKS", 60)
    monkeypatch.setattr(tsne, "large", lambda *a, **k: kept(*a, **k, rounds=3))
    got = {(r.kind, r.id): r.y for r in embedding.layout(rows, "tsne", perplexity=5.0).collect()}
    assert len(got) == 301 and got["center", 0] is None
    y = np.array([got["data", i] for i in range(300)])
    near = np.argsort(embed.squared_distances(y) + 1e9 * np.eye(300), 1)[:, :3]
    assert np.isfinite(y).all() and (label[near] == label[:, None]).mean() > 0.95


def test_pushes_of_a_grid():
    """The grid's fields against sums over all pairs."""
    y = np.random.default_rng(1).normal(0, 4, (500, 2))
    corners = list(tsne._corners(y, 0.125))
    at, of = np.unique(np.concatenate([c for c, _ in corners]), axis=0, return_inverse=True)
    least, push, total = tsne._fields(at, np.bincount(of.ravel(), np.concatenate([w for _, w in corners])), 0.125)
    got = sum(push[tuple((c - least).T)] * w[:, None] for c, w in corners)
    away = y[:, None] - y[None]
    q = 1 / (1 + (away**2).sum(2))
    want = (away * (q * q)[:, :, None]).sum(1)
    assert abs(total / (q.sum() - 500) - 1) < 0.02 and np.abs(got - want).max() < 0.02 * np.abs(want).max()


def test_affinities_have_the_perplexity():
    there = np.ones((5, 40), bool)
    p = tsne.affinities(np.random.default_rng(2).random((5, 40)) * 9, there, 10.0)
    assert np.allclose(np.exp(-(p * np.log(p)).sum(1)), 10.0)
