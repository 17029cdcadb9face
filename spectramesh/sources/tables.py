"""Result tables, plate layouts and numeric array files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectramesh.session import new_path, work_dir


def well_path(root: str | Column = "") -> Column:
    """root/timepoint/zarr/row letter/column/round: the folder of a well."""
    base = F.lit(root) if isinstance(root, str) else root
    return F.concat_ws("/", base, "timepoint", "zarr", F.substring("well", 1, 1), F.substring("well", 2, 100), "round")


def enumerate_items(layout: DataFrame, labels: DataFrame, root: str = "", suffix: str = ".stl") -> DataFrame:
    """timepoint, well, pos, label, mesh_id, path of every labelled item of the layout's wells."""
    both = layout.join(labels, ["timepoint", "well"])
    return both.select("timepoint", "well", "pos", "label", F.concat_ws("_", "timepoint", "well", F.col("label").cast("string")).alias("mesh_id"), F.concat(well_path(root), F.lit("/"), F.col("mesh_name"), F.lit("/"), F.col("label").cast("string"), F.lit(suffix)).alias("path"))


def read_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, name, shape, values (flat, row by row) of the numeric arrays of .npy and .npz files. Objects aren't loaded."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for at, data in zip(p["path"], p["content"], strict=True):
                got = np.load(io.BytesIO(data), allow_pickle=False)
                named = {k: got[k] for k in got.files} if isinstance(got, np.lib.npyio.NpzFile) else {"": got}
                out += [(at, k, list(x.shape), np.asarray(x, float).ravel().tolist()) for k, x in named.items() if np.issubdtype(x.dtype, np.number)]
            yield pd.DataFrame(out, columns=["path", "name", "shape", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, shape array<bigint>, values array<double>")


def read_labels(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, pos, label of vectors of labels, in their order."""
    return read_arrays(spark, path).select("path", F.posexplode("values").alias("pos", "_v")).select("path", "pos", F.col("_v").cast("int").alias("label"))


def write_labels(rows: DataFrame, path: str, group: str, label: str, *order: Column) -> None:
    """A file `<group>.npy` with the vector of labels for each group, in the given order. A group's vector is made in one task; ties go by label."""
    from spectramesh.sources.meshes import put

    place = F.row_number().over(Window.partitionBy("g").orderBy(*order, "l")).alias("p")
    some = rows.select(F.col(group).alias("g"), F.col(label).cast("bigint").alias("l"), "*").select("g", "l", place)

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, part.sort_values("p")["l"].to_numpy(np.int64))
        put(f"{path}/{key[0]}.npy", out.getvalue())
        return pd.DataFrame({"n": [len(part)]})

    some.groupBy("g").applyInPandas(run, "n bigint").write.format("noop").mode("overwrite").save()


def good_labels(features: DataFrame, shapes: DataFrame, key: str = "obs_name", label: str = "label", tol: float = 1.0, most: float = 1.3) -> DataFrame:
    """key, label of the items whose least intensity and sphericity lie within the limits: features and shapes as they come from stores."""
    from spectramesh.operators.quality import quality_filter

    return quality_filter(shapes, features, [key], "C01.min_intensity", "sphericity", tol, most).select(key, F.col(label).cast("int").alias(label))


def settle(df: DataFrame) -> DataFrame:
    """The table as it is now, in the folder of spark.checkpoint.dir (see `session.work_dir`).

    Where eigenvalues coincide, their vectors depend on the last bit of the input; whatever is made from a basis must see the same one.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The table written into the shared folder and read again: cuts the lineage like `settle`, in one pass, and keeps columns prunable."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_bundle(path: str, partition_by: tuple[str, ...] = (), **tables: DataFrame) -> None:
    """Several tables of one result (basis, coefficients, spectra ...) side by side."""
    for name, df in tables.items():
        save(df, f"{path}/{name}", tuple(c for c in partition_by if c in df.columns))


def load_bundle(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_vocabulary(path: str, centers: DataFrame, scaler: DataFrame, sigma: DataFrame, times: list[float]) -> None:
    """Centres, scaler and parameters as plain tables. The time grid belongs to them and is checked on loading."""
    save_bundle(path, centers=centers, scaler=scaler, params=sigma.select("sigma", F.array(*(F.lit(float(t)) for t in times)).alias("times")))


def load_vocabulary(spark: SparkSession, path: str, times: list[float] | None = None) -> dict[str, DataFrame]:
    found = load_bundle(spark, path, "centers", "scaler", "params")
    if times is not None and not np.allclose(found["params"].first()["times"], times):
        raise ValueError("the vocabulary was made with other times")
    return found


def save_layout_csv(layout: DataFrame, path: str, key: str = "id") -> None:
    """key, x, y of a two-dimensional embedding (array y), with a header."""
    layout.select(F.col(key), F.get("y", 0).alias("x"), F.get("y", 1).alias("y")).write.mode("overwrite").option("header", True).csv(path)
