"""Per-mesh kernels: principal axes, the cotangent operator and its lowest eigenpairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Up to so many vertices the eigenproblem is solved densely (8 n^2 bytes, n^3 steps); beyond, by filtered subspace iteration.
DENSE = 3000
BASIS = "mesh_id string, vid int, mass double, phi array<double>, lambdas array<double>, error string"
ALIGNED = "mesh_id string, vid int, x double, y double, z double, rotation array<array<double>>"


def fix_signs(columns: np.ndarray) -> np.ndarray:
    """Turn each column so that its entry of largest size, the first of equals, is positive."""
    if not columns.size:
        return columns
    at = np.argmax(np.round(np.abs(columns), 9), axis=0)
    return columns * np.where(columns[at, np.arange(columns.shape[1])] < 0, -1.0, 1.0)


def principal_axes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centred and rotated vertices, rotation): axes by falling variance."""
    centred = v - v.mean(0)
    _, vectors = np.linalg.eigh(centred.T @ centred / max(1, len(v) - 1))
    rotation = fix_signs(vectors[:, ::-1]).T
    return centred @ rotation.T, rotation


def operator(v: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cotangent Laplacian in coordinates (i, j, w), negative semidefinite, with repeats; and the mixed Voronoi mass."""
    edge = [v[f[:, (k + 2) % 3]] - v[f[:, (k + 1) % 3]] for k in range(3)]
    twice = np.linalg.norm(np.cross(edge[0], edge[1]), axis=1)
    safe = np.where(twice > 0, twice, 1)
    cot = [np.where(twice > 0, -(edge[(k + 1) % 3] * edge[(k + 2) % 3]).sum(1) / safe, 0) for k in range(3)]
    length = [(e * e).sum(1) for e in edge]
    obtuse = np.any([c < 0 for c in cot], axis=0)
    mass, i, j, w = np.zeros(len(v)), [], [], []
    for k in range(3):
        p, q = (k + 1) % 3, (k + 2) % 3
        a, b, half = f[:, p], f[:, q], cot[k] / 2
        i += [a, b, a, b]
        j += [b, a, a, b]
        w += [half, half, -half, -half]
        share = np.where(cot[k] < 0, twice / 4, np.where(obtuse, twice / 8, (length[p] * cot[p] + length[q] * cot[q]) / 8))
        np.add.at(mass, f[:, k], share)
    return np.concatenate(i), np.concatenate(j), np.concatenate(w), mass


def dense(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(i * n + j, w, n * n).reshape(n, n)


def lowest(v: np.ndarray, f: np.ndarray, k: int, dense_limit: int = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, mass) of -L phi = lambda M phi, the k smallest, mass-orthonormal."""
    n = len(v)
    if n <= k:
        raise ValueError(f"{n} vertices are too few for {k} eigenpairs")
    i, j, w, mass = operator(v, f)
    if (mass <= 0).any():
        raise ValueError("a vertex has no area")
    scale = 1 / np.sqrt(mass)
    w = -w * scale[i] * scale[j]
    if n <= dense_limit:
        a = dense(i, j, w, n)
        values, vectors = np.linalg.eigh((a + a.T) / 2)
        values, vectors = values[:k], vectors[:, :k]
    else:
        values, vectors = _filtered(i, j, w, n, k)
    return np.maximum(values, 0) if values[0] > -1e-6 else values, fix_signs(vectors * scale[:, None]), mass


def _filtered(i: np.ndarray, j: np.ndarray, w: np.ndarray, n: int, k: int, degree: int = 24, most: int = 60, tol: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """Subspace iteration with Chebyshev filters: memory n times the subspace, steps linear in the faces."""
    order = np.lexsort((j, i))
    i, j, w = i[order], j[order], w[order]
    begin = np.searchsorted(i, np.arange(n))

    def apply(x: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(w * x[j, c], begin) for c in range(x.shape[1])], axis=1)

    top = float(np.bincount(i, np.abs(w), n).max())
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(n, min(n, k + max(16, k // 4)))))[0]
    cut = top / 4
    for _ in range(most):
        e, c = (top - cut) / 2, (top + cut) / 2
        before, now = x, (apply(x) - c * x) / e
        for _ in range(degree - 1):
            before, now = now, 2 * (apply(now) - c * now) / e - before
        x = np.linalg.qr(now)[0]
        ax = apply(x)
        values, turn = np.linalg.eigh(x.T @ ax)
        x, ax = x @ turn, ax @ turn
        if np.abs(ax[:, :k] - x[:, :k] * values[:k]).max() < tol * top:
            break
        cut = max(float(values[-1]), 1e-9 * top)
    else:
        raise ValueError(f"the {k} lowest eigenpairs of {n} vertices did not converge in {most} rounds")
    return values[:k], x[:, :k]


def _mesh(vertices: pd.DataFrame, faces: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    vertices = vertices.sort_values("vid", kind="stable")
    vid = vertices["vid"].to_numpy()
    return vid, vertices[["x", "y", "z"]].to_numpy(float), np.searchsorted(vid, faces.sort_values("fid", kind="stable")[["a", "b", "c"]].to_numpy())


def eigenbasis(vertices: DataFrame, faces: DataFrame, lmax: int = 15, dense_limit: int = DENSE) -> DataFrame:
    """The first lmax^2 eigenpairs of each mesh: a row per vertex, or one row with the error for a mesh that has none."""

    def run(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        try:
            vid, points, tri = _mesh(v, f)
            values, vectors, mass = lowest(points, tri, lmax * lmax, dense_limit)
        except (ValueError, IndexError, np.linalg.LinAlgError) as e:
            return pd.DataFrame({"mesh_id": [key[0]], "vid": [None], "mass": [None], "phi": [None], "lambdas": [None], "error": [str(e)]})
        return pd.DataFrame({"mesh_id": key[0], "vid": vid, "mass": mass, "phi": list(vectors), "lambdas": [values] * len(vid), "error": None})

    return vertices.groupBy("mesh_id").cogroup(faces.groupBy("mesh_id")).applyInPandas(run, BASIS)


def align(vertices: DataFrame) -> DataFrame:
    """Vertices centred and turned onto their principal axes, with the rotation on each row."""

    def run(key: tuple, v: pd.DataFrame) -> pd.DataFrame:
        v = v.sort_values("vid", kind="stable")
        points, rotation = principal_axes(v[["x", "y", "z"]].to_numpy(float))
        return pd.DataFrame({"mesh_id": key[0], "vid": v["vid"].to_numpy(), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2], "rotation": [rotation.tolist()] * len(v)})

    return vertices.groupBy("mesh_id").applyInPandas(run, ALIGNED)


