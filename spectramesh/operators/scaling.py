"""Standard scaling with the population's deviation, over all rows or within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_scaler(long: DataFrame, value: str, dims: list[str]) -> DataFrame:
    """dims, mean, std: std is the population's, and one where that is zero."""
    std = F.stddev_pop(value)
    return long.groupBy(*dims).agg(F.avg(value).alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))


def transform(long: DataFrame, scaler: DataFrame, value: str, dims: list[str], out: str = "scaled") -> DataFrame:
    return long.join(scaler, dims).withColumn(out, (F.col(value) - F.col("mean")) / F.col("std")).drop("mean", "std")


def inverse(long: DataFrame, scaler: DataFrame, value: str, dims: list[str], out: str = "value") -> DataFrame:
    return long.join(scaler, dims).withColumn(out, F.col(value) * F.col("std") + F.col("mean")).drop("mean", "std")


def scale(long: DataFrame, value: str, dims: list[str], out: str = "scaled") -> DataFrame:
    """Fit and transform. dims with a timepoint scale inside each timepoint; without, over all of them."""
    return transform(long, fit_scaler(long, value, dims), value, dims, out)


def fit_array_scaler(df: DataFrame, vector: str) -> DataFrame:
    """One row: mean and std as arrays by position, for a table of vectors."""
    rows = df.select(F.posexplode(vector).alias("dim", "_v"))
    fitted = fit_scaler(rows, "_v", ["dim"])
    ordered = F.array_sort(F.collect_list(F.struct("dim", "mean", "std")))
    return fitted.agg(ordered.alias("_s")).select(F.transform("_s", lambda x: x["mean"]).alias("mean"), F.transform("_s", lambda x: x["std"]).alias("std"))


def scale_array(df: DataFrame, scaler: DataFrame, vector: str, out: str = "scaled") -> DataFrame:
    """Scale a vector column by a one-row scaler, without exploding it."""
    both = df.crossJoin(F.broadcast(scaler.select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))))
    centred = F.zip_with(vector, "_mean", lambda x, m: x - m)
    return both.withColumn(out, F.zip_with(centred, "_std", lambda x, s: x / s)).drop("_mean", "_std")


def center_and_scale(vertices: DataFrame, mesh: str = "mesh_id", divisor: float | None = None) -> DataFrame:
    """Centre each mesh's vertices, then divide by its largest absolute coordinate (divisor None) or by a number."""
    mean = vertices.groupBy(mesh).agg(*(F.avg(c).alias(f"_{c}") for c in "xyz"))
    out = vertices.join(mean, mesh).select(*(c for c in vertices.columns if c not in ("x", "y", "z")), *((F.col(c) - F.col(f"_{c}")).alias(c) for c in "xyz"))
    if divisor is None:
        largest = out.groupBy(mesh).agg(F.max(F.greatest(*(F.abs(c) for c in "xyz"))).alias("_d"))
        out = out.join(largest, mesh)
        return out.select(*(c for c in out.columns if c not in ("x", "y", "z", "_d")), *(F.try_divide(F.col(c), F.col("_d")).alias(c) for c in "xyz"))
    return out.select(*(c for c in out.columns if c not in ("x", "y", "z")), *((F.col(c) / divisor).alias(c) for c in "xyz"))
