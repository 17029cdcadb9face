"""Real spherical harmonics (4 pi normalised, no alternating sign): least-squares fit and evaluation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from spectramesh.schemas import SH_COEFFICIENTS

GRID = "mesh_id string, lat double, lon double, x double, y double, z double"


def legendre(x: np.ndarray, lmax: int) -> np.ndarray:
    """Normalised associated functions, (lmax + 1, lmax + 1, len(x)), by upward recurrence in the degree."""
    p = np.zeros((lmax + 1, lmax + 1, len(x)))
    s = np.sqrt(np.maximum(0, 1 - x * x))
    p[0, 0] = 1
    for m in range(1, lmax + 1):
        p[m, m] = s * p[m - 1, m - 1] * np.sqrt((2 * m + 1) / (2 * m) * (2 if m == 1 else 1))
    for m in range(lmax + 1):
        for l in range(m + 1, lmax + 1):
            a = np.sqrt((2 * l + 1) * (2 * l - 1) / ((l - m) * (l + m)))
            b = np.sqrt((2 * l + 1) * (l + m - 1) * (l - m - 1) / ((l - m) * (l + m) * (2 * l - 3))) if l > m + 1 else 0
            p[l, m] = a * x * p[l - 1, m] - (b * p[l - 2, m] if l > m + 1 else 0)
    return p


def design(lat: np.ndarray, lon: np.ndarray, lmax: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(points x functions, (sign, l, m) of each): sign 0 cosine, 1 sine; degrees up to lmax inclusive."""
    p, columns, names = legendre(np.sin(np.radians(lat)), lmax), [], []
    for l in range(lmax + 1):
        for m in range(l + 1):
            for sign in (0, 1) if m else (0,):
                columns.append(p[l, m] * (np.sin if sign else np.cos)(m * np.radians(lon)))
                names.append((sign, l, m))
    return np.stack(columns, axis=1), names


def fit_mesh(points: np.ndarray, lat: np.ndarray, lon: np.ndarray, lmax: int) -> tuple[np.ndarray, list]:
    a, names = design(lat, lon, lmax)
    return np.linalg.lstsq(a, points, rcond=None)[0], names


def fit(vertices: DataFrame, angles: DataFrame, lmax: int = 15) -> DataFrame:
    """Coefficients of x, y, z over the sphere: mesh_id, axis, sign, l, m, value. vertices and angles meet on mesh_id and vid."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vid", kind="stable")
        c, names = fit_mesh(rows[["x", "y", "z"]].to_numpy(float), 90 - np.degrees(rows["theta"].to_numpy()), np.degrees(rows["phi"].to_numpy()), lmax)
        return pd.DataFrame([(key[0], axis, s, l, m, float(c[i, axis])) for axis in range(3) for i, (s, l, m) in enumerate(names)], columns=["mesh_id", "axis", "sign", "l", "m", "value"])

    rows = vertices.join(angles.where("error is null").select("mesh_id", "vid", "theta", "phi"), ["mesh_id", "vid"])
    return rows.groupBy("mesh_id").applyInPandas(run, SH_COEFFICIENTS)


def reconstruct(coefficients: DataFrame, rotations: DataFrame, grid_lmax: int = 50) -> DataFrame:
    """Points on a grid of latitudes and longitudes, turned back by the inverse rotation; the centre isn't put back.

    rotations: mesh_id, rotation (3 x 3). The grid has 2 (grid_lmax + 1) steps of latitude, twice as many of longitude, ends included.
    """

    def run(key: tuple, c: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        n = 2 * (grid_lmax + 1)
        lat, lon = (g.ravel() for g in np.meshgrid(90 - np.arange(n + 1) * 180 / n, np.arange(2 * n + 1) * 180 / n, indexing="ij"))
        a, names = design(lat, lon, int(c["l"].max()))
        place = {k: i for i, k in enumerate(names)}
        x = np.zeros((len(names), 3))
        for axis, s, l, m, value in c[["axis", "sign", "l", "m", "value"]].itertuples(index=False):
            x[place[s, l, m], axis] = value
        points = (a @ x) @ np.linalg.inv(np.array([list(x) for x in r["rotation"].iloc[0]], float)).T
        return pd.DataFrame({"mesh_id": key[0], "lat": lat, "lon": lon, "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]})

    return coefficients.groupBy("mesh_id").cogroup(rotations.groupBy("mesh_id")).applyInPandas(run, GRID)
