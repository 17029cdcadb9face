"""Quantiles of all groups at once, drawn seeds, tall least squares, hashed noise, blocked nearest samples: against numpy and plain loops."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spectramesh.functions import columns as C
from spectramesh.kernels import eigen, harmonic_fit
from spectramesh.operators import clustering, harmonics, leastsquares, quality
from spectramesh.sources import tables


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_grouped_quantile(spark, share):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=301), "b": np.repeat([1.0, 5.0, 1e9], 200), "c": np.array([3.0]), "d": np.concatenate([rng.random(99), [-1e300, 1e300]]), "e": np.full(500, 7.0), "f": np.round(rng.normal(size=400), 1)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = {k: float(np.quantile(x, share)) for k, x in groups.items()}
    for near in (1 << 20, 40):
        got = {r.g: r.q for r in quality.grouped_quantile(df, ["g"], "v", share, near).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)


def test_band_statistics_either_way(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("c", l, float(v)) for l in range(3) for v in rng.random(90)], "channel string, l int, power double")
    a, b = ({r.l: (r.median, r.mean, r.std) for r in harmonics.band_statistics(df, near_rows=n).collect()} for n in (1 << 20, 10))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)


def test_seeds_and_kmeans(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(5, 4)) * 20
    x = np.concatenate([m + rng.normal(size=(60, 4)) for m in middles])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id long, x array<double>")
    first = [r.center for r in clustering.seeds(df, 5, "id").orderBy("cluster").collect()]
    assert first == [r.center for r in clustering.seeds(df.repartition(7), 5, "id").orderBy("cluster").collect()]
    # Far clusters: draws by squared distance hit each of them.
    assert len({int(np.argmin(((middles - c) ** 2).sum(1))) for c in first}) == 5
    found = np.array([r.center for r in clustering.kmeans(df, 5, key="id").collect()])
    near = ((found[:, None] - np.array([x[i * 60 : (i + 1) * 60].mean(0) for i in range(5)])[None]) ** 2).sum(2).min(1)
    assert near.max() < 1e-20
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (3, [4.0]), (4, None)], "id long, x array<double>")
    assert sorted(r.center[0] for r in clustering.kmeans(few, 5).collect()) == [1.0, 4.0]


@pytest.mark.parametrize("block", [16, 4096])
def test_least_squares(spark, block):
    rng = np.random.default_rng(3)
    systems = {"tall": (rng.normal(size=(500, 6)), rng.normal(size=(500, 2))), "few": (rng.normal(size=(3, 6)), rng.normal(size=(3, 2))), "flat": (np.repeat(rng.normal(size=(200, 1)), 6, 1), rng.normal(size=(200, 2)))}
    rows = [(g, i, list(map(float, p)), list(map(float, q))) for g, (a, b) in systems.items() for i, (p, q) in enumerate(zip(a, b))] + [("tall", -1, None, [1.0, 1.0]), ("tall", -2, [1.0] * 6, None)]
    df = spark.createDataFrame(rows, "g string, k long, a array<double>, b array<double>").repartition(4)
    got = {r.g: r for r in leastsquares.solve(df, "g", "k", block=block).collect()}
    for g, (a, b) in systems.items():
        want, _, rank, _ = np.linalg.lstsq(a, b, rcond=None)
        assert np.allclose(got[g].solution, want, atol=1e-9) and got[g].rank == rank
        assert np.allclose(got[g].residual, ((a @ want - b) ** 2).sum(0), atol=1e-9)
    assert leastsquares.solve(df.limit(0), "g", "k").collect() == []


def test_harmonics_as_columns(spark):
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(-90, 90, 30), rng.uniform(0, 360, 30)
    lat[:3] = [90, -90, 0]
    df = spark.createDataFrame(pd.DataFrame({"i": range(30), "lat": lat, "lon": lon}))
    got = np.array([r.a for r in leastsquares.harmonics_at(df, F.col("lat"), F.col("lon"), 6).orderBy("i").collect()])
    want, names = harmonic_fit.design(lat, lon, 6)
    assert names == C.harmonic_names(6) and np.allclose(got, want, atol=1e-10)


def test_hashed_noise(spark):
    df = spark.range(20_000).withColumn("z", C.hashed_normal(3, "id"))
    a = [r.z for r in df.orderBy("id").collect()]
    assert a == [r.z for r in spark.range(20_000).repartition(9).withColumn("z", C.hashed_normal(3, "id")).orderBy("id").collect()]
    assert abs(np.mean(a)) < 0.03 and abs(np.std(a) - 1) < 0.03 and abs(np.mean(np.array(a) ** 3)) < 0.1
    assert abs(np.corrcoef(a, [r.z for r in df.select(C.hashed_normal(4, "id").alias("z"), "id").orderBy("id").collect()])[0, 1]) < 0.03
    one = spark.range(5).select(C.noised(F.lit(2.0), 1e-3, 1, "id").alias("v"), C.noised(F.lit(2.0)).alias("w")).collect()
    assert len({r.v for r in one}) == 5 and all(abs(r.v - 2) < 0.01 and r.w == 2 for r in one)


@pytest.mark.parametrize("block", [4, 1024])
def test_nearest_sample_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    s = np.round(rng.random((40, 3)), 1)
    q = np.round(rng.random((15, 3)), 1)
    samples = spark.createDataFrame([(i, list(map(float, v)), [float(i)]) for i, v in enumerate(s)], "id long, code array<double>, x array<double>")
    codes = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(q)] + [(0, list(map(float, q[0])))], "item long, code array<double>")
    got = sorted((r.item, r.x[0]) for r in clustering.decode_by_sample(codes, samples, "id", block=block).collect())
    want = [(i, float(np.lexsort((np.arange(40), ((s - v) ** 2).sum(1)))[0])) for i, v in enumerate(q)]
    assert got == sorted([*want, want[0]])


def test_no_silent_eigenpairs():
    n = 60
    ring = np.arange(n)
    i, j = np.concatenate([ring, ring, ring]), np.concatenate([(ring + 1) % n, (ring - 1) % n, ring])
    w = np.concatenate([-np.ones(2 * n), np.full(n, 2.0)])
    values, _ = eigen._filtered(i, j, w, n, 5)
    assert np.allclose(values, np.sort(2 - 2 * np.cos(2 * np.pi * ring / n))[:5], atol=1e-6)
    with pytest.raises(ValueError, match="did not converge"):
        eigen._filtered(i, j, w, n, 5, degree=1, most=1, tol=1e-14)


def test_label_files(spark, tmp_path):
    rows = spark.createDataFrame([("w1", 5, 2), ("w1", 9, 1), ("w2", 7, 0), ("w1", 3, 1)], "well string, label long, place int")
    tables.write_labels(rows, str(tmp_path), "well", "label", F.col("place"))
    got = {(r.path.rsplit("/", 1)[1], r.pos): r.label for r in tables.read_labels(spark, f"{tmp_path}/*.npy").collect()}
    assert got == {("w1.npy", 0): 3, ("w1.npy", 1): 9, ("w1.npy", 2): 5, ("w2.npy", 0): 7}


def test_landmark_layout_of_many_rows(spark, monkeypatch):
    """Beyond the rows that one task lays out, scaling goes by landmarks; few dimensions are kept exactly, and empty tables stay empty."""
    from spectramesh.kernels import embed
    from spectramesh.operators import embedding

    monkeypatch.setattr(embed, "MOST", 50)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2)) @ rng.normal(size=(2, 7)) + 5
    df = spark.createDataFrame([("data", i, list(map(float, v))) for i, v in enumerate(x)], "kind string, id long, x array<double>")
    y = np.array([r.y for r in embedding.layout(df, "mds").orderBy("id").collect()])
    far = lambda p: np.linalg.norm(p[:, None] - p[None], axis=2)
    assert y.shape == (300, 2) and np.allclose(far(y), far(x), atol=1e-8)
    with pytest.raises(ValueError, match="at most"):
        embedding.layout(df, "tsne")
    assert len(embedding.landmarks(df.where("id < 5"), 64)) == 5 and embedding.landmark_layout(df.limit(0)).collect() == []


def test_first_seen_over_batches(spark, tmp_path):
    """A key comes out once, whichever batch brings it again, early or late."""
    from spectramesh.streaming import ingest

    schema = "k string, n int, at timestamp"
    batches = [[("a", 1, 5), ("a", 1, 3), ("b", 1, 9)], [("a", 1, 1), ("c", 2, 2)], [("b", 1, 9), ("b", 2, 4)]]
    for b in batches:
        spark.createDataFrame([(k, n, datetime(2024, 1, 1, 0, m)) for k, n, m in b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = ingest.first_seen(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["k", "n"], "at").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.k, r.n, r["at"].minute) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 1, 3), ("b", 1, 9), ("b", 2, 4), ("c", 2, 2)]
