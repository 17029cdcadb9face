"""Least squares over groups of any size by tall-skinny QR, and the fit of spherical harmonics with it.

A block of rows [A | b] is reduced to its triangular factor, which has as many rows as columns; factors are stacked and reduced again, level by
level, until a group has one. That loses no precision to normal equations, and no task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectramesh.functions.columns import harmonic_names, legendre_column
from spectramesh.sources.tables import written

BLOCK = 4096


def solve(rows: DataFrame, group: str, key: str, a: str = "a", b: str = "b", block: int = BLOCK) -> DataFrame:
    """group, solution (an array per unknown, with an entry per right side), rank, residual (array: sums of squares per right side).

    rows: group, key, a (array: coefficients), b (array: right sides). Rank-deficient systems get the solution of least norm. Rows with
    a null array are left out. The number of unknowns must be well below `block`.
    """
    some = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("_k"), F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"))
    size = some.groupBy("g").agg(F.ceil(F.count("*") / block).alias("parts"))  # a row per group
    level = some.join(size, "g").withColumn("part", F.pmod(F.xxhash64("_k"), F.col("parts"))).select("g", "part", "a", "b")
    most = size.agg(F.max("parts")).first()[0] or 0

    def reduce(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.array(p[c].to_list(), float).reshape(len(p), -1) for c in ("a", "b")], 1)
        n = len(p["a"].iloc[0])
        # Rows in a fixed order, so that the factor doesn't depend on how they arrived.
        r = np.linalg.qr(x[np.lexsort(x.T[::-1])], mode="r")
        return pd.DataFrame({"g": [key[0]] * len(r), "part": [int(key[1])] * len(r), "a": list(r[:, :n]), "b": list(r[:, n:])})

    kind = some.schema["g"].dataType.simpleString()
    while most > 1:
        level = written(level.groupBy("g", "part").applyInPandas(reduce, f"g {kind}, part bigint, a array<double>, b array<double>"), "factors")
        # A block holds as many factors as fit; eight at least, so that levels end.
        wide = level.select((F.size("a") + F.size("b")).alias("w")).agg(F.max("w")).first()[0]
        fan = max(8, block // max(1, wide))
        level, most = level.withColumn("part", F.floor(F.col("part") / fan)), -(-most // fan)

    def finish(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.array(p[c].to_list(), float).reshape(len(p), -1) for c in ("a", "b")], 1)
        n = len(p["a"].iloc[0])
        x = x[np.lexsort(x.T[::-1])]
        found, _, rank, _ = np.linalg.lstsq(x[:, :n], x[:, n:], rcond=None)
        left = ((x[:, :n] @ found - x[:, n:]) ** 2).sum(0)
        return pd.DataFrame({"g": [key[0]], "solution": [[list(map(float, r)) for r in found]], "rank": [int(rank)], "residual": [list(map(float, left))]})

    out = level.groupBy("g").applyInPandas(finish, f"g {kind}, solution array<array<double>>, rank int, residual array<double>")
    return out.withColumnRenamed("g", group)


def harmonics_at(df: DataFrame, latitude: Column, longitude: Column, lmax: int, out: str = "a") -> DataFrame:
    """Adds an array with the real spherical harmonics up to degree lmax (4 pi normalised) at a place in degrees, in the order of `harmonic_names`."""
    df = df.withColumns({"_x": F.sin(F.radians(latitude)), "_lon": F.radians(longitude)})
    df = df.withColumns({f"_p{m}": legendre_column("_x", m, lmax) for m in range(lmax + 1)})
    values = F.array(*(F.get(f"_p{m}", l - m) * (F.sin(m * F.col("_lon")) if sign else F.cos(m * F.col("_lon"))) for sign, l, m in harmonic_names(lmax)))
    return df.withColumn(out, values).drop("_x", "_lon", *(f"_p{m}" for m in range(lmax + 1)))


def fit_harmonics(points: DataFrame, lmax: int, mesh: str = "mesh_id", key: str = "vid", block: int = BLOCK) -> DataFrame:
    """mesh, axis, sign, l, m, value: coefficients of x, y, z over the sphere. points: mesh, key, theta, phi (radians), x, y, z."""
    rows = harmonics_at(points, 90 - F.degrees("theta"), F.degrees("phi"), lmax).withColumn("b", F.array("x", "y", "z"))
    found = solve(rows, mesh, key, block=block)
    names = F.array(*(F.struct(F.lit(s).alias("sign"), F.lit(l).alias("l"), F.lit(m).alias("m")) for s, l, m in harmonic_names(lmax)))
    both = found.select(mesh, F.posexplode("solution").alias("_i", "_v")).withColumn("_n", F.get(names, F.col("_i")))
    return both.select(mesh, F.posexplode("_v").alias("axis", "value"), "_n.sign", "_n.l", "_n.m").select(mesh, "axis", "sign", "l", "m", "value")
