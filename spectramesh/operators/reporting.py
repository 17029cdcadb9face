"""What plots show, as tables; nothing is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surface(points: DataFrame, values: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """mesh, vid, x, y, z, value: a scalar over the vertices."""
    return points.select(mesh, "vid", "x", "y", "z").join(values.select(mesh, "vid", "value"), [mesh, "vid"])


def scatter(layout: DataFrame, *keep: str) -> DataFrame:
    """x, y and the kept columns of a two-dimensional embedding."""
    return layout.select(*keep, F.get("y", 0).alias("x"), F.get("y", 1).alias("y"))


def highlighted(layout: DataFrame, times: DataFrame, key: str = "id") -> DataFrame:
    """timepoint, x, y, cluster, shown: every point once for each timepoint, shown where it is its own."""
    t = times.select("timepoint").distinct().select(F.col("timepoint").alias("panel"))
    # A handful of timepoints.
    return layout.join(times.select(key, "timepoint"), key).crossJoin(F.broadcast(t)).select("panel", "x", "y", "cluster", (F.col("panel") == F.col("timepoint")).alias("shown"))


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def distinct_sorted(df: DataFrame, by: str) -> DataFrame:
    return df.select(by).distinct().orderBy(by)


def field_ranges(fields: DataFrame, by: str = "field", value: str = "value") -> DataFrame:
    return fields.groupBy(by).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def shape_classes(classes: DataFrame) -> DataFrame:
    """mesh_id, shape of a table shape, meshes (array)."""
    return classes.select(F.explode("meshes").alias("mesh_id"), "shape")
