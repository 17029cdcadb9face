"""Spectral descriptors over a persisted eigenbasis: projection, reconstruction, heat-kernel signatures, band power.

A basis is a table (mesh key, vid, mass, phi) with phi an array of one entry per mode, ascending; eigenvalues are an array column
`lambdas` on the same rows or are joined by the mesh key. Fields and coefficients are in long form.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectramesh.functions.columns import amplitude, degree, degree_weight, heat_kernel
from spectramesh.operators import blocks
from spectramesh.operators.quality import NEAR_ROWS, grouped_quantile


def modes(basis: DataFrame, mesh: str, *keep: str) -> DataFrame:
    """One row per vertex and mode: mesh, vid, mode, p and the kept columns."""
    return basis.select(mesh, "vid", *keep, F.posexplode("phi").alias("mode", "p"))


def project(basis: DataFrame, fields: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Coefficients mesh, channel, mode, c = sum over vertices of phi * mass * value. fields: mesh, vid, channel, value.

    Vertices are joined before the modes are exploded, and sums are combined before the shuffle.
    """
    rows = basis.join(fields, [mesh, "vid"]).select(mesh, "channel", (F.col("mass") * F.col("value")).alias("_w"), F.posexplode("phi").alias("mode", "_p"))
    return rows.groupBy(mesh, "channel", "mode").agg(F.sum(F.col("_p") * F.col("_w")).alias("c"))


def reconstruct(basis: DataFrame, coeffs: DataFrame, lmax: int, mesh: str = "mesh_id", available: int | None = None) -> DataFrame:
    """mesh, vid, channel, value from the first lmax^2 modes; lmax 0 gives zeros. available: the basis's own lmax, to check against."""
    if available is not None and lmax > available:
        raise ValueError(f"lmax {lmax} exceeds the basis's {available}")
    channels = coeffs.select(mesh, "channel").distinct()
    points = basis.select(mesh, "vid").join(channels, mesh)
    used = coeffs.where(F.col("mode") < lmax * lmax)
    sums = modes(basis, mesh).where(F.col("mode") < lmax * lmax).join(used, [mesh, "mode"]).groupBy(mesh, "vid", "channel").agg(F.sum(F.col("p") * F.col("c")).alias("value"))
    return points.join(sums, [mesh, "vid", "channel"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def residuals(basis: DataFrame, coeffs: DataFrame, points: DataFrame, lmax: int, mesh: str = "mesh_id") -> DataFrame:
    """mesh, l, vid, sq: squared distance of each point from its reconstruction with l^2 modes, l = 0..lmax.

    Each degree's share is computed once and summed up over degrees. points: mesh, vid, channel, value; those without a basis are left out.
    """
    points = points.join(basis.select(mesh, "vid"), [mesh, "vid"], "left_semi")
    used = coeffs.where(F.col("mode") < lmax * lmax)
    share = modes(basis, mesh).where(F.col("mode") < lmax * lmax).join(used, [mesh, "mode"]).groupBy(mesh, "vid", "channel", (degree("mode") + 1).alias("l")).agg(F.sum(F.col("p") * F.col("c")).alias("_s"))
    start = points.select(mesh, "vid", "channel", F.lit(0).alias("l"), F.lit(0.0).alias("_s"))
    upto = Window.partitionBy(mesh, "vid", "channel").orderBy("l").rowsBetween(Window.unboundedPreceding, 0)
    near = share.unionByName(start).withColumn("_r", F.sum("_s").over(upto))
    return near.join(points, [mesh, "vid", "channel"]).groupBy(mesh, "l", "vid").agg(F.sum(F.pow(F.col("value") - F.col("_r"), 2)).alias("sq"))


def recon_error_curve(basis: DataFrame, coeffs: DataFrame, points: DataFrame, lmax: int, mesh: str = "mesh_id") -> DataFrame:
    """mesh, l, error (Frobenius norm), mean_error (mean distance of a vertex), for l = 0..lmax."""
    return residuals(basis, coeffs, points, lmax, mesh).groupBy(mesh, "l").agg(F.sqrt(F.sum("sq")).alias("error"), F.avg(F.sqrt("sq")).alias("mean_error"))


def recon_quality(basis: DataFrame, coeffs: DataFrame, points: DataFrame, lmax: int, mesh: str = "mesh_id") -> DataFrame:
    """mesh, error: the Frobenius norm of the reconstruction with lmax^2 modes; not divided by the number of vertices."""
    return recon_error_curve(basis, coeffs, points, lmax, mesh).where(F.col("l") == lmax).select(mesh, "error")


def heat_kernel_signature(basis: DataFrame, times: Column | list[float], mesh: str = "mesh_id", lambdas: str = "lambdas") -> DataFrame:
    """mesh, vid, t_index, t, h: sum over modes of exp(-lambda t) phi^2."""
    ts = times if isinstance(times, Column) else F.array(*(F.lit(float(t)) for t in times))
    rows = basis.select(mesh, "vid", ts.alias("_t"), heat_kernel(lambdas, "phi", ts).alias("_h"))
    return rows.select(mesh, "vid", F.posexplode(F.arrays_zip(F.col("_t").alias("t"), F.col("_h").alias("h"))).alias("t_index", "_z")).select(mesh, "vid", "t_index", "_z.t", "_z.h")


def hks_coefficients(basis: DataFrame, times: Column | list[float], mesh: str = "mesh_id", lambdas: str = "lambdas") -> DataFrame:
    """Projection of the signature at each time: mesh, channel (`hks-t`), mode, c."""
    fields = heat_kernel_signature(basis, times, mesh, lambdas).select(mesh, "vid", F.concat(F.lit("hks-"), F.col("t_index").cast("string")).alias("channel"), F.col("h").alias("value"))
    return project(basis, fields, mesh)


def compute_coefficients(basis: DataFrame, coordinates: DataFrame, fields: DataFrame | None = None, times: list[float] | None = None, mesh: str = "mesh_id") -> DataFrame:
    """Coefficients of coordinates, of marker fields and of signatures in one table: mesh, kind, channel, mode, c."""
    out = project(basis, coordinates, mesh).withColumn("kind", F.lit("v"))
    if fields is not None:
        out = out.unionByName(project(basis, fields, mesh).withColumn("kind", F.lit("fm")))
    if times is not None:
        out = out.unionByName(hks_coefficients(basis, times, mesh).withColumn("kind", F.lit("hks")))
    return out


def band_power(coeffs: DataFrame, lmax: int, mesh: str = "mesh_id", available: int | None = None) -> DataFrame:
    """mesh, channel, l, power: sum of squared coefficients of each degree below lmax."""
    if available is not None and lmax > available:
        raise ValueError(f"lmax {lmax} exceeds the coefficients' {available}")
    rows = coeffs.where(F.col("mode") < lmax * lmax)
    return rows.groupBy(mesh, "channel", degree("mode").alias("l")).agg(F.sum(F.col("c") * F.col("c")).alias("power"))


def surface_area(basis: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    return basis.groupBy(mesh).agg(F.sum("mass").alias("area"))


def band_amplitude(coeffs: DataFrame, areas: DataFrame, lmax: int, mode: str = "root_over_area", mesh: str = "mesh_id") -> DataFrame:
    """mesh, channel, l, amplitude. areas: mesh, area."""
    return band_power(coeffs, lmax, mesh).join(areas, mesh).select(mesh, "channel", "l", amplitude("power", "area", mode).alias("amplitude"))


def squared_length(coeffs: DataFrame, mesh: str = "mesh_id", weighted: bool = True) -> DataFrame:
    """mesh, channel, length: sum of c^2, weighted by the root of 1 / (2 l + 1) if asked."""
    w = F.sqrt(degree_weight("mode")) if weighted else F.lit(1.0)
    return coeffs.groupBy(mesh, "channel").agg(F.sum(F.col("c") * F.col("c") * w).alias("length"))


def inner_product(a: DataFrame, b: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """mesh, channel_a, channel_b, inner: sum of a b / (2 l + 1) over the modes of both, for every channel of a with every one of b.

    A channel's coefficients are one array by mode, and blocks of channels meet as matrices. Pairs without a mode in common are left out.
    """

    def lists(df: DataFrame) -> DataFrame:
        held = df.where(F.col(mesh).isNotNull()).groupBy(F.col(mesh).alias("g"), F.col("channel").alias("key")).agg(F.map_from_entries(F.collect_list(F.struct("mode", "c"))).alias("_m"), F.max("mode").alias("_last"))
        return held.select("g", "key", F.transform(F.sequence(F.lit(0), "_last"), lambda m: F.try_element_at("_m", m).cast("double")).alias("v"))

    x = lists(a)
    return blocks.products(x, x if b is a else lists(b), (mesh, "channel_a", "channel_b", "inner"), lambda n: [1.0 / (2 * math.isqrt(m) + 1) for m in range(n)])


def band_statistics(spectra: DataFrame, value: str = "power", near_rows: int = NEAR_ROWS) -> DataFrame:
    """channel, l, median, mean, std (population) over all meshes."""
    by = ["channel", "l"]
    sums = spectra.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    middle = grouped_quantile(spectra, by, value, 0.5, near_rows).withColumnRenamed("q", "median")
    return sums.join(middle, by, "left").select(*by, "median", "mean", "std")


def log_spectra(spectra: DataFrame, value: str = "power", offset: float | None = 1e-10) -> DataFrame:
    """Add `log`: ln(value + offset). offset None: the least mean over meshes of any degree and channel."""
    if offset is not None:
        return spectra.withColumn("log", F.log(F.col(value) + F.lit(float(offset))))
    least = spectra.groupBy("l", "channel").agg(F.avg(value).alias("_m")).agg(F.min("_m").alias("_least"))
    return spectra.crossJoin(F.broadcast(least)).withColumn("log", F.log(F.col(value) + F.col("_least"))).drop("_least")


def append_channels(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Coefficients of several kinds of channels in one table."""
    for o in others:
        first = first.unionByName(o)
    return first
