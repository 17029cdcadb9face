"""What the operators share: the shared work folder, bounded samples, range buckets and prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once; with it, memory doesn't depend on the batch size of Arrow.
CHUNK_BYTES = 4 << 20


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of an Arrow batch. Documents of some kilobytes then make batches of some megabytes, in the JVM and in Python.
BATCH_ROWS = 1000
#: Settings of Python workers by which they give memory back that a task has used.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver's copy of it is visible to them, and bound their memory."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: What a task's end calls to let go of things that the worker hasn't used for a while.
idle: list[Callable[[], None]] = []


def give_back() -> None:
    """Return freed memory to the system at a task's end; workers live on for other tasks."""
    for forget in idle:
        forget()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new local one, in local mode alone."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        at = spark.sparkContext.getCheckpointDir() or _local_dir(spark)
    return at.rstrip("/")


def _local_dir(spark: SparkSession) -> str:
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="spectramesh-")
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir()


def free(name: str, columns: Iterable[str]) -> str:
    """A column name that isn't among `columns`: the given one, with as many underscores as it takes."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but those that are to be kept: for work of which all that is needed later is written."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it again: it cuts the lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_named(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """A table and a column that tells its rows apart: the key where it is distinct and never null, else numbers in a written copy."""
    rows, keys = df.select(F.count("*"), F.count_distinct(key)).first()
    if rows == keys:
        return df, key
    at = free("_row", df.columns)
    return materialize(df.withColumn(at, F.monotonically_increasing_id()), "numbered"), at


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key's decimal text, mod n; null for null."""
    return F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key.cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the key: the same ones wherever the rows lie.

    The share comes from the table's count, so the expected size doesn't depend on it. A key that repeats often
    is taken or left as a whole; twice the rows bound that case, and those with the smallest hashes stay.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return df
    share = int(rows / total * 2**32)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(2**32))
    some = df.where(place < share)
    return some if some.limit(2 * rows + 1).count() <= 2 * rows else some.orderBy(place, *some.columns).limit(2 * rows)


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of text, and one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        begin, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += int(n)
        yield batch.slice(begin)
    give_back()


def put_bytes(path: str, data: bytes) -> None:
    """Write a file of the shared folder as a whole: a reader sees all of it or nothing."""
    if path.startswith("file:") or "://" not in path:
        local = _local(path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(f"{local}.{uuid.uuid4().hex}.tmp", "wb") as f:
            f.write(data)
        os.replace(f.name, local)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as f:
        f.write(data)


def get_bytes(path: str) -> bytes:
    if path.startswith("file:") or "://" not in path:
        with open(_local(path), "rb") as f:
            return f.read()
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return f.read()


def get_range(path: str, at: int, n: int) -> bytes:
    """n bytes of a file from a place on."""
    if path.startswith("file:") or "://" not in path:
        with open(_local(path), "rb") as f:
            f.seek(at)
            return f.read(n)
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(n, at)


def _local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Up to parts-1 ascending cut points of a long key, from an approximate quantile sketch."""
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx(F.col(key), F.array(*map(F.lit, shares)), 10 * parts)).first()[0]
    return sorted({int(x) for x in found or []})


def bucket(key: str, bounds: list[int]) -> Column:
    """How many bounds are below the key: rows of equal keys share a bucket; null keys are in bucket 0."""
    if not bounds:
        return F.lit(0)
    cuts = F.from_json(F.lit(str(bounds)), "array<bigint>")
    low, high, steps = F.lit(0), F.lit(len(bounds)), len(bounds).bit_length()
    # A binary search in a fold: (low, high) narrows until low is the number of bounds < key.
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(low.alias("a"), high.alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s).otherwise(
            F.when(F.get(cuts, F.floor((s["a"] + s["b"]) / 2).cast("int")) < F.col(key), F.struct((F.floor((s["a"] + s["b"]) / 2) + 1).cast("int").alias("a"), s["b"].alias("b"))).otherwise(
                F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b"))
            )
        ),
    )
    return F.coalesce(state["a"], F.lit(0))


#: Rows of a table of one or two longs that a broadcast may hold: some 40 MB in an executor.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialized table for broadcast if it has at most `rows` rows; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def by_key(rows: DataFrame, facts: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """rows joined with a materialized table of one row per key, whose column n says how many rows have that key.

    A table of at most `most` rows is broadcast. Of a larger one the keys are that have more than a `most`-th of all rows - fewer than
    `most` of them - and the others are joined by shuffle, so that no task sees more of one key than that.
    """
    if facts.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(facts), on, how)
    limit = facts.agg(F.sum("n")).first()[0] // most
    hot = facts.where(F.col("n") > limit)
    named = F.broadcast(hot.select(*on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(named, on, "left_anti").join(facts.where(F.col("n") <= limit), on, how))


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among `keys` (one column, materialized). Rows with a null key stay."""
    name = keys.columns[0]
    return df.join(small(keys), df[key] == keys[name], "left_anti")


#: Rows of a line that one task adds up.
RUN_ROWS = 1 << 16


def running(df: DataFrame, group: str, position: str, value: Column | dict[str, Column], name: str = "", rows: int = RUN_ROWS) -> DataFrame:
    """Add the sum of `value` over the rows before this one in its group, by position (gapless or nearly so); of several, by name.

    Two passes: windows over runs of at most `rows` positions, and prefix sums over the runs' totals. No task sees a whole group.
    """
    values = value if isinstance(value, dict) else {name: value}
    run = F.floor(F.col(position) / rows).alias("_run")
    df = df.withColumns({f"_value_{n}": v for n, v in values.items()}).withColumn("_run", run)
    totals = df.groupBy(group, "_run").agg(*(F.sum(f"_value_{n}").alias(f"_total_{n}") for n in values))
    # One row per run of 65,536 rows: a billionth of the table, by group in order.
    before = Window.partitionBy(group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(group, "_run", *(F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in values))
    own = Window.partitionBy(group, "_run").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *(F.coalesce(F.sum(f"_value_{n}").over(own), F.lit(0)).alias(f"_own_{n}") for n in values)).join(bases, [group, "_run"])
    return df.withColumns({n: F.col(f"_base_{n}") + F.col(f"_own_{n}") for n in values}).drop("_run", *(f"_{x}_{n}" for n in values for x in ("value", "base", "own")))
