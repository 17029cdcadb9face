"""New mesh files and event windows as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType


def windowed(events: DataFrame, time: str, keys: list[str], value: str, size: str = "1 day", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count, sum and mean of `value` by event-time window and keys; rows later than `late` are dropped once their window is final."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, size, slide).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: start, end, n."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def mesh_stream(spark: SparkSession, path: str) -> DataFrame:
    """New mesh files as they arrive: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)


def for_each_batch(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply a batch operator to every micro-batch and write it to a folder of its number: a batch that is run again replaces its own output."""

    def sink(df: DataFrame, number: int) -> None:
        apply(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(items: DataFrame, keys: list[str], time: str) -> DataFrame:
    """keys, time of the items that the stream meets for the first time, each key once: what is done is skipped by keyed state, however late it comes again.

    Within a batch the earliest row of a key counts, so a batch that is run again emits the same rows.
    """
    schema = StructType([f for f in items.schema.fields if f.name in keys] + [StructField("_first", TimestampType())])
    state = StructType([StructField("done", BooleanType())])

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        least = None
        for b in batches:
            at = b["_at"].min()
            least = at if least is None or at < least else least
        if not held.exists and least is not None:
            held.update((True,))
            yield pd.DataFrame({**{f.name: [v] for f, v in zip(schema.fields, key, strict=False)}, "_first": [least]})

    names = [f.name for f in schema.fields[:-1]]
    rows = items.select(*names, F.col(time).cast("timestamp").alias("_at"))
    found = rows.groupBy(*names).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)
    return found.withColumnRenamed("_first", time)


def remember_first(stream: DataFrame, keys: list[str], time: str, out: str, checkpoint: str) -> StreamingQuery:
    """`first_seen` for any number of keys: each micro-batch writes the keys that no earlier batch's folder in `out` has, with their least time.

    A batch that is run again compares itself with the folders before its own and replaces that one.
    """

    def sink(df: DataFrame, number: int) -> None:
        now = df.groupBy(*keys).agg(F.min(F.col(time).cast("timestamp")).alias(time))
        if number:
            kinds = {f.name: f.dataType for f in df.schema.fields}
            schema = StructType([StructField(k, kinds[k]) for k in keys] + [StructField("batch", LongType())])
            done = df.sparkSession.read.schema(schema).parquet(out).where(F.col("batch") < number).select(*(F.col(k).alias(f"_{k}") for k in keys))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            now = now.join(done.hint("merge"), same, "left_anti")
        now.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen_table(spark: SparkSession, table: DataFrame, keys: list[str], time: str, folder: str) -> DataFrame:
    """Run `remember_first` over a table's rows, ordered by time in files, and once more over copies of the files: the result is a table of each key once."""
    table = table.select(*keys, time)
    path, schema = f"{folder}/in", table.schema
    table.orderBy(time).write.mode("append").parquet(path)
    for run in range(2):
        if run:
            table.write.mode("append").parquet(path)  # everything comes again, later
        remember_first(spark.readStream.schema(schema).parquet(path), keys, time, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(*keys, F.col(time).alias("first"))


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return its result."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
