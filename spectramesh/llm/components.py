"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.llm.common import BROADCAST_ROWS, by_key, materialize


def components(links: DataFrame, most_rounds: int = 50, most: int = BROADCAST_ROWS) -> DataFrame:
    """links: a, b (long). Rows node, component for every node with a link; component is the smallest node reachable.

    Links point from the larger node to the smaller. The large star moves each to the smallest node that its target knows; the small
    star joins a node's targets to the smallest of them. Targets that know none smaller - the hubs that most links share - have
    no row in the table of smallest nodes. It is broadcast up to `most` rows, so that hubs gather nowhere; beyond that only what
    is known of the targets with the most links is, and the others are joined by shuffle. Every round's table is written to the shared folder, so a lost
    executor costs one round. Rounds end when a table repeats; they are logarithmic in the longest path.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _digest(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        known = materialize(edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), "least")
        large = materialize(_look_up(edges, known, most).select("a", F.coalesce("m", "b").alias("b")).distinct(), "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        moved = by_key(large, least, ["a"], most=most).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = _digest(edges)
        if after == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = after
    raise RuntimeError(f"no end after {most_rounds} rounds")


def _look_up(edges: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """a, b, m: each link with the smallest node that its target knows, null where it knows none."""
    if known.limit(most + 1).count() <= most:
        return edges.join(F.broadcast(known), "b", "left")
    targets = materialize(edges.groupBy("b").agg(F.count("*").alias("n")).join(known, "b", "left"), "targets")
    return by_key(edges, targets, ["b"], most=most)


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary")))).first())
