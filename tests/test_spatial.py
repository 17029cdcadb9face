"""Cells of space against all pairs, over small blocks; and how many pairs a large group takes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectramesh.operators import information, spatial


def cloud(spark, n=400, dim=2, copies=True):
    rng = np.random.default_rng(dim)
    rows = [("a", i, rng.normal(size=dim).tolist()) for i in range(n)] + [("b", i, (rng.random(dim) ** 4).tolist()) for i in range(n // 2)]
    if copies:
        rows += [("a", 10_000 + i, rows[3][2]) for i in range(60)] + [("c", i, [1.0] * dim) for i in range(40)] + [("d", 1, [0.0] * dim), ("d", 2, [2.0] * dim), ("d", 3, [2.0] * dim), ("d", 4, [5.0] * dim), ("d", 5, [5.5] * dim)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, i long, x array<double>")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("dim, metric", [(1, "euclidean"), (2, "euclidean"), (3, "chebyshev")])
def test_neighbours(spark, dim, metric):
    df = cloud(spark, dim=dim)
    want = rows_of(information.neighbours(df, "g", "i", "x", 3, metric))
    placed = spatial.place(df, "g", "i", "x", alone=30)
    assert placed.select("g", "cell").distinct().count() > 10
    assert rows_of(spatial.nearest(placed, 3, metric)) == want
    assert rows_of(information.neighbours(df, "g", "i", "x", 3, metric, block=50)) == want


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("dim", [1, 3])
def test_counts(spark, dim, strict):
    df = cloud(spark, dim=dim).withColumn("r", F.when(F.col("i") % 7 == 0, 0.0).otherwise((F.col("i") % 11) / 5.0))
    want = rows_of(information.count_within(df, "g", "i", "x", "r", strict))
    radii = df.select("g", "i", "r")
    assert rows_of(spatial.within(spatial.place(df, "g", "i", "x", alone=30), radii, strict)) == want


def test_estimates_are_the_same(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, [float(a)], [float(0.6 * a + b)], [float(c)]) for g in "pq" for i, (a, b, c) in enumerate(rng.normal(size=(90, 3)))]
    df = spark.createDataFrame(rows, "g string, id long, x array<double>, y array<double>, z array<double>")

    def both(f):
        return [[(r[0], *(round(v, 9) for v in r[1:])) for r in rows_of(f(b))] for b in (2048, 40)]

    for f in (lambda b: information.multivariate_mutual_information(df, "g", "id", ["x", "y", "z"], 3, block=b), lambda b: information.entropy(df.withColumn("xy", F.concat("x", "y")), "g", "id", "xy", 2, 3, block=b)):
        one, two = both(f)
        assert one == two
    long = df.select("g", "id", F.inline(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("v")) for c in "xy"))))
    one, two = ({tuple(r[:3]): tuple(r[3:]) for r in information.mi_matrix(long, "g", "id", "f", "v", block=b).collect()} for b in (2048, 40))
    assert one.keys() == two.keys() and len(one) == 8
    assert all(np.allclose(one[k], two[k], atol=1e-9) for k in one)
    with pytest.raises(Exception, match="points"):
        information.mutual_information(df.unionByName(df.limit(2).withColumn("g", F.lit("tiny"))), "g", "id", "x", "y", 3, 1, block=40).collect()


def test_pairs_of_a_large_group(spark):
    """A group of 50,000 points: the k nearest of a part are those of a full search, and pairs stay far below a tenth of all."""
    n = 50_000
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.array(F.randn(1), F.randn(2)).alias("x"))
    df = spatial.written(df)
    placed = spatial.place(df, "g", "i", "x")
    found = spatial.written(spatial.nearest(placed, 3, "chebyshev"))
    assert found.count() == 3 * n
    sizes = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) < 1000 and len(sizes) > 150
    x = np.array([r.x for r in df.orderBy("i").collect()])
    for r in found.where("i % 5000 = 0").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("rank", "j"))).alias("s")).collect():
        d = np.abs(x - x[r.i]).max(1)
        d[r.i] = np.inf
        assert [e["j"] for e in r.s] == np.lexsort((np.arange(n), d))[:3].tolist()
    # What meets: own cells, and the cells that a point's radius touches.
    assert sum(s * s for s in sizes.values()) < n * n / 100
