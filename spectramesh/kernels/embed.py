"""Low-dimensional layouts of one small table, and points from distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A layout is made in one task and needs all distances: 8 n^2 bytes.
MOST = 5000


def squared_distances(x: np.ndarray) -> np.ndarray:
    s = (x * x).sum(1)
    d = np.maximum(0, s[:, None] + s[None] - 2 * x @ x.T)
    np.fill_diagonal(d, 0)
    return d


def tsne(x: np.ndarray, components: int = 2, perplexity: float = 30.0, seed: int = 42, steps: int = 500) -> np.ndarray:
    """Exact t-SNE; starts from the principal components."""
    n = len(x)
    if n < 3:
        return np.zeros((n, components))
    d, p = squared_distances(x), np.zeros((n, n))
    goal = np.log(min(perplexity, (n - 1) / 3))
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(60):  # a width per point, such that the neighbours' entropy is that of the perplexity
        p = np.exp(-(d - np.where(np.eye(n, dtype=bool), np.inf, d).min(1)[:, None]) * beta[:, None])
        np.fill_diagonal(p, 0)
        p /= p.sum(1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        low, high = np.where(h > goal, beta, low), np.where(h > goal, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = pca(x, components)
    y = y / max(1e-12, y[:, 0].std()) * 1e-4 + np.random.default_rng(seed).normal(0, 1e-6, (n, components))
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(50.0, n / 48)
    for t in range(steps):
        q = 1 / (1 + squared_distances(y))
        np.fill_diagonal(q, 0)
        pull = ((12.0 if t < 250 else 1.0) * p - np.maximum(q / q.sum(), 1e-12)) * q
        g = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.maximum(np.where((g > 0) != (speed > 0), gain + 0.2, gain * 0.8), 0.01)
        speed = (0.5 if t < 250 else 0.8) * speed - rate * gain * g
        y = y + speed
    return y - y.mean(0)


def pca(x: np.ndarray, components: int) -> np.ndarray:
    from spectramesh.kernels.eigen import fix_signs

    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    y = fix_signs(u[:, :components]) * s[:components]
    return np.pad(y, ((0, 0), (0, components - y.shape[1])))


def mds(x: np.ndarray, components: int = 2, seed: int = 42, steps: int = 300, tol: float = 1e-6) -> tuple[np.ndarray, list[float]]:
    """(layout, stress after each step) by majorisation from the principal components."""
    n, d = len(x), np.sqrt(squared_distances(x))
    y, stress = pca(x, components) + np.random.default_rng(seed).normal(0, 1e-9, (n, components)), []
    for _ in range(steps):
        e = np.sqrt(squared_distances(y))
        stress.append(float(((d - e) ** 2).sum() / 2))
        if len(stress) > 1 and stress[-2] - stress[-1] <= tol * max(stress[-2], 1e-300):
            break
        b = -np.where(e > 0, d / np.where(e > 0, e, 1), 0)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(1))
        y = b @ y / n
    return y, stress


def from_distances(centers: np.ndarray, d: np.ndarray, seed: int = 42) -> np.ndarray:
    """The point at given distances from the centres, by the differences of the squared equations to the first one.

    Least squares, of least norm where that leaves a choice. With one centre: at its distance in a fixed random direction.
    """
    if len(centers) == 1:
        way = np.random.default_rng(seed).normal(size=centers.shape[1])
        return centers[0] + d[0] * way / np.linalg.norm(way)
    a = 2 * (centers[1:] - centers[0])
    b = (d[0] ** 2 - d[1:] ** 2) + (centers[1:] ** 2).sum(1) - (centers[0] ** 2).sum()
    return np.linalg.lstsq(a, b, rcond=None)[0]


def intersect_spheres(centers: Column, distances: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([from_distances(np.array([list(x) for x in one], float), np.asarray(r, float)) for one, r in zip(c, d, strict=True)])

    return run(centers, distances)
