"""Whole jobs over mesh files: from files to coefficients, spectra and descriptors."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from spectramesh.kernels import eigen
from spectramesh.operators import harmonics, scaling
from spectramesh.session import ship
from spectramesh.sources import meshes, tables


class Stages:
    """What a job's stages did: rows, rows that failed, seconds. Counts come with the stage's own pass (an observation), not from a second one."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, float]] = []

    def run(self, name: str, df: DataFrame, failed: Column | None = None) -> DataFrame:
        """The stage's table, settled; `failed` marks rows that stand for an item without a result."""
        seen, began = Observation(name), time.monotonic()
        bad = F.lit(False) if failed is None else failed
        out = tables.settle(df.observe(seen, F.count_if(~bad).alias("rows"), F.count_if(bad).alias("failed")))
        self.rows.append((name, int(seen.get["rows"]), int(seen.get["failed"]), time.monotonic() - began))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """stage, rows, failed, seconds."""
        return spark.createDataFrame(self.rows, "stage string, rows bigint, failed bigint, seconds double")


def decompose(spark: SparkSession, path: str | list[str], lmax: int = 15, times: list[float] | None = None, divisor: float = 10.0, stages: Stages | None = None) -> dict[str, DataFrame]:
    """basis, coefficients, vertices, faces and status of every mesh file: centre and rescale once, align, eigenbasis, projections.

    status has a row per file that failed, with its error. Meshes without fields are fine. stages: told what each stage did.
    """
    ship(spark)
    stages = stages or Stages()
    files = stages.run("read", meshes.read_meshes(spark, path), F.col("status") == "error")
    aligned = stages.run("align", eigen.align(scaling.center_and_scale(meshes.vertices(files), divisor=divisor)))
    found = stages.run("eigenbasis", eigen.eigenbasis(aligned.drop("rotation"), meshes.faces(files), lmax), F.col("error").isNotNull())
    basis = found.where("error is null").drop("error")
    points = aligned.select("mesh_id", "vid", F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "xyz"))))
    fields = meshes.vertex_fields(files).withColumnRenamed("field", "channel")
    failed = files.where("status = 'error'").select("mesh_id", "status", "error").unionByName(found.where("error is not null").select("mesh_id", F.lit("error").alias("status"), "error"))
    return {"basis": basis, "coefficients": harmonics.compute_coefficients(basis, points, fields, times), "vertices": aligned, "faces": meshes.faces(files), "status": failed}


def run_pending(spark: SparkSession, items: DataFrame, done: DataFrame, out: str, lmax: int = 15) -> dict[str, DataFrame]:
    """Decompose the items (mesh_id, path) without output yet, and save. The list of paths is the job's input and is on the driver."""
    paths = [r.path for r in items.join(done, "mesh_id", "left_anti").select("path").collect()]
    if not paths:
        return {}
    found = decompose(spark, paths, lmax)
    tables.save_bundle(out, **found)
    return found
