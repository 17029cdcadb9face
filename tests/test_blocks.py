"""Blocks of all pairs against plain sums and sorts: copies, missing entries, vectors of many components."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectramesh.operators import blocks, harmonics, information, spatial


def test_inner_products_of_blocks(spark, monkeypatch):
    """Channels with few modes, none in common, nulls and an infinite number; blocks of a few channels; no row per mode and pair."""
    inf = float("inf")
    rows = [("m", c, m, float(c + m)) for c in range(30) for m in range(c % 4, 6)] + [("m", 90, 9, 1.0), ("m", 91, 0, inf), ("m", 92, 1, None), ("n", 1, 2, 3.0)]
    df = spark.createDataFrame(rows, "mesh_id string, channel long, mode int, c double")
    held = {}
    for mesh, ch, mode, c in rows:
        if c is not None:
            held.setdefault((mesh, ch), {})[mode] = c
    want = {}
    for (ma, a), x in held.items():
        for (mb, b), y in held.items():
            both = x.keys() & y.keys()
            if ma == mb and both:
                want[ma, a, b] = sum(x[m] * y[m] / (2 * int(m**0.5) + 1) for m in both)
    kept = blocks.products
    monkeypatch.setattr(blocks, "products", lambda *a: kept(*a, least=4, most=4))
    found = harmonics.inner_product(df, df)
    got = {tuple(r[:3]): r[3] for r in found.collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], equal_nan=True) for k in want)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_inner_products_by_strips(spark, monkeypatch):
    """Blocks of several strips, a table with itself and with another one, whose channels have names, other modes, and groups of its own."""
    rng = np.random.default_rng(4)
    rows = [(g, ch, m, float(np.round(rng.normal(), 3))) for g, n in (("m", 40), ("n", 3), ("o", 1)) for ch in range(n) for m in range(ch % 3, 4 + ch % 5)]
    more = [(g, f"b{ch}", m + 1, 0.5 * c) for g, ch, m, c in rows if g != "o" and ch % 4] + [("p", "b", 0, 1.0)]
    a, b = spark.createDataFrame(rows, "mesh_id string, channel long, mode int, c double"), spark.createDataFrame(more, "mesh_id string, channel string, mode int, c double")
    kept = blocks.products
    monkeypatch.setattr(blocks, "products", lambda *args: kept(*args, least=7, most=7, strip=3))
    for other, theirs in ((a, rows), (b, more)):
        want = {}
        for g, x, m, c in rows:
            for h, y, k, d in theirs:
                if (g, m) == (h, k):
                    want[g, x, y] = want.get((g, x, y), 0.0) + c * d / (2 * int(m**0.5) + 1)
        found = [tuple(r) for r in harmonics.inner_product(a, other).collect()]
        got = {r[:3]: r[3] for r in found}
        assert len(got) == len(found) and got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_rows_meet_few_blocks(spark, monkeypatch):
    """However large a group, each row is sent to as many blocks: what is shuffled grows with rows, not with pairs."""
    kept, held = blocks.met, []

    def met(*args):
        held.append(kept(*args[:4], lambda left, right: pa.table({"n": [left.num_rows + right.num_rows]}), "n long"))
        return kept(*args)

    monkeypatch.setattr(blocks, "met", met)
    for n in (8000, 32000):
        df = spark.range(n).select(F.lit("m").alias("mesh_id"), F.col("id").alias("channel"), F.lit(0).alias("mode"), F.lit(1.0).alias("c"))
        harmonics.inner_product(df, df)
    assert [h.agg(F.sum("n")).first()[0] for h in held] == [7 * 8000, 7 * 32000]


@pytest.mark.parametrize("metric", ["euclidean", "chebyshev"])
def test_neighbours_of_long_vectors(spark, monkeypatch, metric):
    """Copies across blocks, ties by id, two groups; a large group of long vectors doesn't go by cells of space."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(60, 8)), 1)
    rows = [("a", i, x[i % 60].tolist()) for i in range(150)] + [("b", i, x[i].tolist()) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, i long, x array<double>")
    want = sorted(tuple(r) for r in information.neighbours(df, "g", "i", "x", 3, metric).collect())
    assert sorted(tuple(r) for r in blocks.nearest(df, "g", "i", "x", 3, metric, least=20, most=20).collect()) == want
    monkeypatch.setattr(spatial, "nearest", None)
    assert sorted(tuple(r) for r in information.neighbours(df, "g", "i", "x", 3, metric, block=100).collect()) == want


def test_points_are_never_broadcast(spark):
    """Joins of a row or more per point are merged, however small the tables look."""
    df = spark.range(400).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.array(F.rand(1), F.rand(2)).alias("x"), F.lit(0.1).alias("r"))
    placed = spatial.place(df, "g", "i", "x", alone=30)
    for found in (spatial.nearest(placed, 3), spatial.within(placed, df.select("g", "i", "r"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") >= 2
        assert not any("BroadcastHashJoin" in line and " i#" in line for line in plan.splitlines())


def test_fits_take_the_steps_of_their_sql(spark, data, monkeypatch):
    from spectramesh.operators import clustering
    from spectramesh.plans import QUERIES

    told, kept = [], clustering.kmeans
    monkeypatch.setattr(clustering, "kmeans", lambda points, k, vector="x", seed=42, steps=100, key=None: told.append(steps) or kept(points, k, vector, seed, 1, key))
    QUERIES["kmeans_vocabulary"](spark, data)
    QUERIES["extractor_fit"](spark, data)
    assert told == [60, 60, 60]


def test_first_seen_by_batches(spark, tmp_path):
    """Null keys and keys of earlier batches; a key is written once, with the least time of its first batch."""
    from spectramesh.streaming import ingest

    src, schema = f"{tmp_path}/in", "k long, at timestamp"
    for rows in ([(1, 5), (1, 3), (None, 4)], [(1, 1), (2, 9), (None, 2)]):
        spark.createDataFrame(rows, "k long, s long").select("k", F.timestamp_seconds("s").alias("at")).write.mode("append").parquet(src)
        ingest.remember_first(spark.readStream.schema(schema).parquet(src), ["k"], "at", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("batch", "k", F.unix_seconds("at")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == [(0, 1, 3), (0, None, 4), (1, 2, 9)]


def test_landmark_rounds_stay_small(spark):
    """Thirty landmarks of long vectors: no expression grows with them; equals go by the smallest key."""
    from spectramesh.operators import embedding

    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 16))
    df = spark.createDataFrame([(i, x[i % 100].tolist()) for i in range(200)] + [(900, None)], "id long, x array<double>")
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < 30:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    assert [k for k, _ in embedding.landmarks(df, 30)] == chosen
    y = embedding.landmark_layout(df, 2, 30)
    assert len(y._jdf.queryExecution().toString()) < 5000
    assert {r.id: r.y for r in y.collect()}[900] == [None, None]
