"""Bag-of-features descriptors: signatures of vertices in words of a vocabulary, projected and summed up by degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.functions.columns import heat_kernel
from spectramesh.operators import clustering, harmonics, scaling


def signatures(basis: DataFrame, times: list[float], mesh: str = "mesh_id", lambdas: str = "lambdas") -> DataFrame:
    """mesh, vid, h: the heat-kernel signature of each vertex as one array."""
    ts = F.array(*(F.lit(float(t)) for t in times))
    return basis.select(mesh, "vid", heat_kernel(lambdas, "phi", ts).alias("h"))


def vertex_codes(basis: DataFrame, times: list[float], scaler: DataFrame, centers: DataFrame, sigma: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """mesh, vid, code: scaled signatures softly assigned to the vocabulary. One projection, no shuffle: scaler, centres and sigma are a few rows."""
    scaled = scaling.scale_array(signatures(basis, times, mesh), scaler, "h", "x").select(mesh, "vid", "x")
    return clustering.encode(scaled, centers, sigma).select(mesh, "vid", "code")


def code_coefficients(basis: DataFrame, codes: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Codes projected onto the basis: mesh, channel (`word-k`), mode, c."""
    fields = codes.select(mesh, "vid", F.posexplode("code").alias("k", "value")).select(mesh, "vid", F.concat(F.lit("word-"), F.col("k").cast("string")).alias("channel"), "value")
    return harmonics.project(basis, fields, mesh)


def code_spectrum(basis: DataFrame, codes: DataFrame, lmax: int, mode: str = "root_over_area", mesh: str = "mesh_id") -> DataFrame:
    """mesh, channel, l, amplitude of the codes' coefficients."""
    return harmonics.band_amplitude(code_coefficients(basis, codes, mesh), harmonics.surface_area(basis, mesh), lmax, mode, mesh)


def fit_vocabulary(basis: DataFrame, times: list[float], words: int = 8, seed: int = 42, mesh: str = "mesh_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centers, scaler, sigma) over the signatures of all vertices."""
    h = signatures(basis, times, mesh)
    scaler = scaling.fit_array_scaler(h, "h")
    x = scaling.scale_array(h, scaler, "h", "x")
    centers = clustering.kmeans(x.withColumn("_key", F.concat_ws(":", mesh, "vid")), words, "x", seed, key="_key")
    return centers, scaler, clustering.bandwidth(x, centers)
