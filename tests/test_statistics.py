"""Estimators against known truths, scalers and clusters at their edges, streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectramesh.operators import clustering, embedding, information, quality, scaling
from spectramesh.streaming import ingest


def gauss(spark, rho, n=600, seed=42):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    y = rho * x + math.sqrt(1 - rho**2) * rng.normal(size=n)
    return spark.createDataFrame([(0, i, [float(a)], [float(b)]) for i, (a, b) in enumerate(zip(x, y))], "g int, id int, x array<double>, y array<double>")


@pytest.mark.parametrize("method", [1, 2])
@pytest.mark.parametrize("variant", ["reference", "paper"])
def test_correlated_gaussians(spark, method, variant):
    got = information.mutual_information(gauss(spark, 0.8), "g", "id", "x", "y", 5, method, variant=variant).first()
    assert abs(got.mi - 0.5108) < 0.15


def test_independent_and_entropy(spark):
    df = gauss(spark, 0.0)
    got = information.mutual_information(df, "g", "id", "x", "y", 5, 2).first()
    assert got.mi_raw < 0.1 and got.mi == max(0.0, got.mi_raw)
    assert abs(information.entropy(df, "g", "id", "x", 1, 5).first().entropy - (1.4189 - math.log(2))) < 0.8
    assert information.multivariate_mutual_information(gauss(spark, 0.8), "g", "id", ["x", "y"], 5).first().mi > 0.35


def test_errors(spark):
    df = gauss(spark, 0.5, 3)
    with pytest.raises(ValueError):
        information.mutual_information(df, "g", "id", "x", "y", 3, 3)
    with pytest.raises(ValueError):
        information.multivariate_mutual_information(df, "g", "id", ["x"])
    with pytest.raises(Exception, match="are needed"):
        information.mutual_information(df, "g", "id", "x", "y", 3).collect()
    assert information.mutual_information(gauss(spark, 0.5, 4), "g", "id", "x", "y", 3).count() == 1


def test_quality_edges(spark):
    nan = float("nan")
    mesh = spark.createDataFrame([(1, 1.0), (2, 1.3), (3, 1.31), (4, nan), (5, None), (6, 1.0), (7, 1.0), (8, 1.0)], "k int, `s.p` double")
    feat = spark.createDataFrame([(1, 0.99), (2, 1.0), (4, 5.0), (5, 5.0), (6, nan), (7, None), (9, 3.0)], "k int, `C01.min_intensity` double")
    assert sorted(r.k for r in quality.quality_filter(mesh, feat, ["k"], "C01.min_intensity", "s.p").collect()) == [2, 4, 5, 6, 7, 8]
    names = spark.createDataFrame([("abcde", "A")], "prefix string, label string")
    with pytest.raises(Exception, match="unknown field prefix"):
        quality.exclude_labels(spark.createDataFrame([("zzzzz9",)], "field string"), names).collect()
    assert quality.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect()[0].n == 2


def test_scaler_edges(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 1.0), (1, 3.0)], "d int, v double")
    assert sorted(r.scaled for r in scaling.scale(df, "v", ["d"]).collect()) == [-1.0, 0.0, 0.0, 1.0]


def test_ties_and_methods(spark):
    points = spark.createDataFrame([(1, [0.0]), (2, [2.0])], "id long, x array<double>")
    centers = spark.createDataFrame([(0, [-1.0]), (1, [1.0])], "cluster int, center array<double>")
    assert [r.cluster for r in clustering.assign(points, centers).orderBy("id").collect()] == [0, 1]
    codes = clustering.encode(points, centers, clustering.bandwidth(points, centers))
    with pytest.raises(ValueError, match="sphere_intersection"):
        clustering.decode(codes, centers, "gaussian")
    back = clustering.decode(codes.select("id", "code"), centers, "sphere_intersection", sigma=clustering.bandwidth(points, centers).first()[0])
    assert [round(r.x[0], 6) for r in back.orderBy("id").collect()] == [0.0, 2.0]
    with pytest.raises(ValueError):
        embedding.reduce_dimensions(points, centers, "nothing")
    with pytest.raises(ImportError):
        embedding.reduce_dimensions(points, centers, "UMAP")
    assert embedding.reduce_dimensions(points, centers, "PCA", 1).count() == 4
    flat = clustering.flatten_codes(codes.withColumn("l", F.col("id")).withColumn("item", F.lit(1)), "item", "l")
    assert clustering.unflatten(flat, "item", 2).count() == 2


def test_lloyd_and_extractor(spark):
    rng = np.random.default_rng(3)
    rows = [(i, l, t, float(np.exp(rng.normal(3 * (i % 2) * (l + 1), 0.1)))) for i in range(24) for l in range(3) for t in range(4)]
    spectra = spark.createDataFrame(rows, "id long, l int, t int, power double")
    found, centers = clustering.SpectralFeatures(n_words=3, n_clusters=2).fit_transform(spectra)
    got = {r.id: r.cluster for r in found.collect()}
    assert len({got[i] for i in range(0, 24, 2)}) == 1 and got[0] != got[1] and centers.count() == 2
    points = spark.createDataFrame([(i, [float(i % 2 * 10 + i / 100)]) for i in range(20)], "id long, x array<double>")
    start = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [900.0])], "cluster int, center array<double>")
    c = {r.cluster: r.center[0] for r in clustering.lloyd(points, start, 3).collect()}
    assert abs(c[0] - 0.09) < 0.01 and abs(c[1] - 10.1) < 0.01 and c[2] == 900.0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:05:00"), (1, "2024-01-01 00:10:00"), (1, "2024-01-01 03:00:00"), (2, "2024-01-01 00:06:00")], "user int, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), "user int, ts timestamp")
    q = ingest.for_each_batch(stream, lambda df: df.groupBy("user").count(), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination()
    assert {r.user: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: 3, 2: 1}
    got = ingest.run_to_memory(ingest.sessions(stream, "ts", "user"), "sessions_here")
    assert sorted((r.user, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.obj").write_text("v 0 0 0\n")
    files = ingest.mesh_stream(spark, str(tmp_path / "m"))
    assert files.isStreaming


def test_exact_quantiles_in_brackets(spark):
    """A table too large to be sorted out at once, with ties, hot values and nulls."""
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=6000), np.repeat([1.0, 2.0, 7.0], [4000, 1500, 500]), np.concatenate([np.zeros(5000), rng.exponential(size=1000)]), np.arange(5000.0)):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)] * 5, "v double").repartition(3)
        shares = (0.0, 0.25, 0.5, 0.9, 0.95, 0.999, 1.0)
        for near in (200, 1 << 20):
            assert np.allclose(quality.exact_quantiles(df, "v", shares, near).first()["q"], np.quantile(values, shares), rtol=0, atol=1e-12)
    assert quality.exact_quantiles(df.limit(0), "v", (0.5,)).first()["q"] is None


def test_pairs_in_blocks(spark):
    df = spark.createDataFrame([(g, i, [float(i * 7 % 13), float(i)]) for g in range(2) for i in range(30)], "g int, i int, x array<double>")
    want = sorted(map(tuple, information.pair_distances(df, "g", "i", ["x"]).collect()))
    assert sorted(map(tuple, information.pair_distances(df, "g", "i", ["x"], block=4).collect())) == want and len(want) == 2 * 30 * 30
