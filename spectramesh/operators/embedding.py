"""Low-dimensional embeddings: principal components and landmark layouts over any number of rows, neighbour graphs, layouts of small tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from spectramesh.kernels import embed
from spectramesh.operators import blocks, tsne
from spectramesh.operators.clustering import stack_with_centers
from spectramesh.operators.information import neighbour_lists
from spectramesh.sources.tables import written

METHODS = ("pca", "tsne", "mds", "umap")


def principal_components(points: DataFrame, components: int, vector: str = "x") -> DataFrame:
    """One row: mean (array), loadings (components x dimensions), variance, share (of the total variance), by falling variance.

    Mean and products are summed in the executors; the driver gets one d x d matrix. Each loading's largest entry is positive.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    from spectramesh.kernels.eigen import fix_signs

    rows = points.select(array_to_vector(F.col(vector)).alias("v"))
    both = rows.select(Summarizer.metrics("mean", "variance").summary(F.col("v")).alias("s")).select("s.mean", "s.variance").first()
    k = min(components, len(both["mean"]))
    model = PCA(k=k, inputCol="v", outputCol="y").fit(rows)
    vectors, share, total = fix_signs(model.pc.toArray()), model.explainedVariance.toArray(), float(both["variance"].toArray().sum())
    row = (both["mean"].toArray().tolist(), vectors.T.tolist(), (share * total).tolist(), share.tolist())
    return points.sparkSession.createDataFrame([row], "mean array<double>, loadings array<array<double>>, variance array<double>, share array<double>")


def project(points: DataFrame, model: DataFrame, vector: str = "x", out: str = "y") -> DataFrame:
    """Add the centred projection onto the loadings, as an array."""
    m = model.select(F.col("mean").alias("_m"), F.col("loadings").alias("_l"))
    one = lambda l: F.aggregate(F.zip_with(F.zip_with(vector, "_m", lambda a, b: a - b), l, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return points.crossJoin(F.broadcast(m)).withColumn(out, F.transform("_l", one)).drop("_m", "_l")


def loadings(model: DataFrame) -> DataFrame:
    """pc, dim, loading in long form."""
    return model.select(F.posexplode("loadings").alias("pc", "_l")).select("pc", F.posexplode("_l").alias("dim", "loading"))


def landmarks(points: DataFrame, n: int, key: str = "id", vector: str = "x") -> list[tuple[object, list[float]]]:
    """(key, vector) of n points far from each other: the one of the smallest key, then again and again the point farthest from those so far, the smallest key of equals.

    A round is one pass over a written copy of the points, where each batch keeps its farthest row. Fewer distinct points give fewer landmarks.
    """
    rows = written(points.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).where(F.col(vector).isNotNull()), "points")
    first = rows.agg(F.min(F.struct("k", "x")).alias("w")).first().w
    if first is None:
        return []
    chosen = [(first.k, [float(v) for v in first.x])]
    schema = StructType([StructField("d", DoubleType()), *rows.schema.fields])
    while len(chosen) < n:
        won = rows.mapInArrow(_farthest(np.array([x for _, x in chosen])), schema).agg(F.min(F.struct((-F.col("d")).alias("d"), "k", "x")).alias("w")).first().w
        if won is None or not -won.d > 0:
            break
        chosen.append((won.k, [float(v) for v in won.x]))
    return chosen


def _apart(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Squared distances, summed component by component: equal rows have equal ones."""
    d = np.zeros((len(x), len(marks)))
    for c in range(marks.shape[1]):
        d += np.subtract.outer(x[:, c], marks[:, c]) ** 2
    return d


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; what is missing is NaN."""
    x, there = blocks.matrix(pa.chunked_array([column]))
    return np.pad(np.where(there, x, np.nan), ((0, 0), (0, max(0, width - x.shape[1]))), constant_values=np.nan)


def _farthest(marks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.nan_to_num(_apart(_rows(b.column(1), marks.shape[1]), marks).min(1), nan=-1.0)
                ties = np.flatnonzero(near == near.max())
                keys = b.column(0).take(pa.array(ties))
                at = ties[pc.sort_indices(keys)[0].as_py()] if len(ties) > 1 else ties[0]
                yield pa.RecordBatch.from_arrays([pa.array([near[at]]), b.column(0).slice(at, 1), b.column(1).slice(at, 1)], ["d", "k", "x"])

    return run


def squared(a: Column, b: Column) -> Column:
    """The squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def landmark_layout(points: DataFrame, components: int = 2, n: int = 64, key: str = "id", vector: str = "x", out: str = "y") -> DataFrame:
    """Adds a layout of any number of rows: the landmarks are laid out by classical scaling, and every row is placed by its distances to them.

    The driver holds the landmarks alone. Where the vectors span no more dimensions than there are components, all distances are kept.
    """
    from spectramesh.kernels.eigen import fix_signs

    x = np.array([v for _, v in landmarks(points, n, key, vector)], float)
    if not len(x):
        return points.withColumn(out, F.lit(None).cast("array<double>"))
    d2 = embed.squared_distances(x)
    centre = np.eye(len(x)) - 1 / len(x)
    values, vectors = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
    values, vectors = values[::-1][:components], fix_signs(vectors[:, ::-1][:, :components])
    real = values > 1e-9 * max(float(values[0]), 1e-300)
    back = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    back = np.pad(back, ((0, 0), (0, components - back.shape[1])))
    mean = d2.mean(0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = -0.5 * (_apart(_rows(b.column(names.index(vector)), x.shape[1]), x) - mean) @ back
            flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * components, pa.int32()), flat)], [*names, out])

    names = points.columns
    return points.mapInArrow(place, StructType([*points.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def _ragged(near: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distances as rows, which of them there are, and the neighbours one after another."""
    many = near.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = near.flatten()
    there = np.arange(int(many.max(initial=0))) < many[:, None]
    d = np.zeros(there.shape)
    d[there] = flat.field("d").to_numpy(zero_copy_only=False)
    return d, there, flat.field("j")


def _memberships(e: np.ndarray, there: np.ndarray, goal: float, halvings: int) -> np.ndarray:
    """exp(-e / sigma), where each row's sigma, found by halving, makes them add up to the goal."""
    near = lambda s: np.where(there, np.where(e > 0, np.exp(-e / s[:, None]), 1.0), 0.0)
    low, high, mid = np.zeros(len(e)), np.full(len(e), np.inf), np.ones(len(e))
    with np.errstate(all="ignore"):
        for _ in range(halvings):
            wide = near(mid).sum(1) > goal
            low, high = np.where(wide, low, mid), np.where(wide, mid, high)
            mid = np.where(np.isinf(high), low * 2, (low + high) / 2)
        return near(mid)


def fuzzy_graph(points: DataFrame, k: int = 15, key: str = "id", vector: str = "x", group: str | None = None, halvings: int = 64) -> DataFrame:
    """i, j, w: the neighbour graph that a UMAP layout starts from, each pair once (i < j), of each group by itself.

    A point's k nearest get memberships exp(-(d - rho) / sigma): rho is its nearest positive distance, and sigma, found by halving over
    the point's own list, makes them add up to log2(k). The two directions a, b of a pair join to a + b - a b.
    """
    rows = points.select((F.col(group) if group else F.lit(0)).alias("part_of"), F.col(key).alias("point"), F.col(vector).alias("at"))
    near = neighbour_lists(rows, "part_of", "point", "at", k, "euclidean")
    kind = near.schema["i"].dataType

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, there, j = _ragged(b.column("near"))
            rho = np.where(there & (d > 0), d, np.inf).min(1, initial=np.inf)
            e = np.maximum(0.0, d - np.where(np.isinf(rho), 0.0, rho)[:, None])
            w = _memberships(e, there, math.log2(k), halvings)
            i = b.column("i").take(pa.array(np.nonzero(there)[0]))
            yield pa.RecordBatch.from_arrays([i, j, pa.array(w[there])], ["i", "j", "w"])

    told = near.select("i", "near").mapInArrow(weigh, StructType([StructField("i", kind), StructField("j", kind), StructField("w", DoubleType())]))
    told = told.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w")
    both = told.groupBy("a", "b").agg(F.sum("w").alias("s"), F.min("w").alias("lo"), F.max("w").alias("hi"), F.count("*").alias("n"))
    return both.select(F.col("a").alias("i"), F.col("b").alias("j"), (F.col("s") - F.when(F.col("n") == 2, F.col("lo") * F.col("hi")).otherwise(0.0)).alias("w"))


def layout(rows: DataFrame, method: str, components: int = 2, seed: int = 42, perplexity: float = 30.0) -> DataFrame:
    """kind, id, x, y of a small table kind, id, x: t-SNE, MDS or UMAP over all of it, in one task. Over `embed.MOST` rows, MDS goes by landmarks and t-SNE by rounds over all rows (`tsne`); UMAP raises an error."""
    if rows.limit(embed.MOST + 1).count() > embed.MOST:
        if method == "mds":
            return landmark_layout(rows.select("kind", "id", "x"), components)
        if method == "tsne":
            return tsne.large(rows.select("kind", "id", "x"), components, seed=seed, perplexity=perplexity)
        raise ValueError(f"{method} lays out {embed.MOST} rows at most, since it holds all distances")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["kind", "id"], kind="stable")
        x = np.stack(p["x"].to_list()).astype(float)
        if method == "tsne":
            y = embed.tsne(x, components, perplexity, seed)
        elif method == "mds":
            y = embed.mds(x, components, seed)[0]
        else:
            import umap

            y = umap.UMAP(n_components=components, random_state=seed).fit(x[(p["kind"] == "data").to_numpy()]).transform(x)
        return p.assign(y=list(y))

    return rows.groupBy(F.lit(0).alias("_one")).applyInPandas(lambda p: run(p[["kind", "id", "x"]]), "kind string, id long, x array<double>, y array<double>")


def reduce_dimensions(points: DataFrame, centers: DataFrame, method: str = "pca", components: int = 2, seed: int = 42) -> DataFrame:
    """kind (data, center), id, x, y. points: id, x. Method names are not case-sensitive.

    pca is fitted on the data alone and applied to both; tsne and mds lay out both together; umap needs its package.
    """
    name, both = method.lower(), stack_with_centers(points, centers)
    if name == "pca":
        return project(both, principal_components(points, components))
    if name in ("tsne", "mds"):
        return layout(both, name, components, seed)
    if name == "umap":
        try:
            import umap  # noqa: F401
        except ImportError as e:
            raise ImportError("method umap needs the package umap-learn") from e
        return layout(both, name, components, seed)
    raise ValueError(f"unknown method {method!r}: {', '.join(METHODS)}")
