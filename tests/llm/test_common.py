"""The shared helpers: buckets, samples, prefix sums, files and settings."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from spectramesh.llm import common


def test_buckets(spark):
    bounds = [-5, 0, 7, 7_000_000_000]
    keys = [None, -(2**62), -6, -5, -4, 0, 1, 7, 8, 7_000_000_000, 2**62]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", common.bucket("k", bounds).alias("b")).collect()
    assert {r.k: r.b for r in got} == {k: 0 if k is None else int(np.searchsorted(bounds, k)) for k in keys}
    assert {r.b for r in spark.createDataFrame([(k,) for k in keys], "k bigint").select(common.bucket("k", []).alias("b")).collect()} == {0}
    cuts = common.range_bounds(spark.range(1000), "id", 4)
    assert len(cuts) == 3 and all(abs(c - 250 * (i + 1)) < 30 for i, c in enumerate(cuts))
    assert common.range_bounds(spark.range(0), "id", 4) == []


def test_sample_is_bounded_and_stable(spark):
    a = {r.id for r in common.bounded_sample(spark.range(20_000), "id", 500).collect()}
    b = {r.id for r in common.bounded_sample(spark.range(20_000).repartition(7), "id", 500).collect()}
    assert a == b and 380 < len(a) < 620
    assert common.bounded_sample(spark.range(100), "id", 500).count() == 100
    assert common.bounded_sample(spark.range(3000).select(F.lit(1).alias("id")), "id", 500).count() <= 1000


def test_running_sums(spark):
    rows = [(g, p, v) for g in (0, 1) for p, v in enumerate(np.random.default_rng(g).integers(0, 9, 300).tolist())]
    got = common.running(spark.createDataFrame(rows, "g int, p bigint, v bigint"), "g", "p", F.col("v"), "s", 16).collect()
    for g in (0, 1):
        mine = sorted((r.p, r.v, r.s) for r in got if r.g == g)
        assert [s for *_, s in mine] == [sum(v for _, v, _ in mine[:i]) for i in range(len(mine))]


def test_chunks():
    texts = ["a" * n for n in (1, 5, 100, 2, 0)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["key", "text"])
    parts = list(common.chunks([batch.slice(0, 0), batch], most=10))
    assert [p.num_rows for p in parts] == [2, 1, 3] and [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))


def test_files_and_settings(spark, tmp_path):
    for path in (f"{tmp_path}/a/b.bin", f"file://{tmp_path}/c/d.bin"):
        common.put_bytes(path, b"xyz")
        assert common.get_bytes(path) == b"xyz"
    common.ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= common.BATCH_ROWS
    assert common.work_dir(spark) == common.work_dir(spark)
    df = spark.range(3).select("id", F.lit(None).cast("string").alias("s"))
    assert common.materialize(df, "t").dtypes == df.dtypes
    kept = common.without(spark.createDataFrame([(1,), (2,), (None,)], "k bigint"), spark.createDataFrame([(2,)], "_g bigint"), "k")
    assert sorted(r.k or 0 for r in kept.collect()) == [0, 1]
    common.give_back()
