"""Hard-negative mining by bit-sliced integer products (operator 11).

Components are whole numbers, floor(scale * x), and a score is their inner product with the anchor's. A component of b bits is its
bit-planes: the highest counts -2^(b-1) where it is set, the others 2^k. Planes are taken most significant first; the product of a plane
with the anchor is added to what is known of the score, and what the planes below can still bring lies between (2^k - 1) times the sum of
the anchor's negative components and as many times the sum of its positive ones. So a pair has an interval that tightens from plane to
plane, and it is dropped as soon as its interval can't qualify: for positives, once its upper end is below the k-th best lower end;
for negatives, once it is beside all of the anchor's windows or below the k-th best lower end of those that are surely in the lowest one.
While many pairs are left a plane's products are one matrix product, then they are computed pair by pair. All sums are exact.

Two searches: each anchor's positives, then the negatives in the windows that their scores open. In both a task has a block of
candidates and streams files of anchors through it - the stated query set against all rows, in blocks - and hands on each anchor's best
of the block; a window over the anchor merges them.

Rows whose id, label or vector is null, or with a null or non-finite component, take no part. Vectors of another length than the anchor's
are none of its candidates. Rows that share an id are told apart: each anchor row gets its own rows, and another row of its id is an
other row. Ties go to the smaller id. Components beyond 2^26 count as 2^26 with their sign. A positive with a negative score opens no window. Empty tables
give an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectramesh.llm.common import get_bytes, give_back, materialize, new_path, put_bytes, ship
from spectramesh.llm.vectors import blocks, finite, integers, matrix

#: Pairs that a search holds at once, and the share of them up to which pairs are computed one by one.
AT_ONCE, FEW = 1 << 20, 0.2
_LEAST = np.iinfo(np.int64).min


def planes(x: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes of whole numbers in two's complement, most significant first, and what a set bit of each counts."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    bits = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length()) + 1
    return [((x >> k) & 1).astype(np.uint8) for k in range(bits - 1, -1, -1)], [-(1 << (bits - 1)), *(1 << k for k in range(bits - 2, -1, -1))]


def kth(group: np.ndarray, value: np.ndarray, k: int, groups: int) -> np.ndarray:
    """The k-th largest value of each group (ascending numbers); the least long where a group has fewer."""
    first, out = np.searchsorted(group, np.arange(groups + 1)), np.full(groups, _LEAST)
    for g in np.flatnonzero(np.diff(first) >= k):
        some = value[first[g] : first[g + 1]]
        out[g] = np.partition(some, len(some) - k)[len(some) - k]
    return out


class Pairs:
    """All pairs of some anchors with a block's candidates, as far as they are left: scores known to the planes taken so far.

    anchor, row: numbers of the pairs' anchors (ascending) and candidates. taken: products of one pair with one plane, over all planes.
    """

    def __init__(self, anchors: np.ndarray, slices: list[np.ndarray], weights: list[int], start: np.ndarray):
        self.a, self.slices, self.weights = anchors, slices, weights
        self.least, self.most = np.minimum(anchors, 0).sum(1), np.maximum(anchors, 0).sum(1)
        self.anchor, self.row = np.nonzero(start)
        self.score, self.taken = np.zeros(len(self.anchor), np.int64), 0

    def run(self, qualify) -> None:
        """qualify(anchor, low, high): which pairs may still be wanted. It is asked after every plane; after the last, low is high and the score."""
        for bits, weight in zip(self.slices, self.weights, strict=True):
            self.taken += len(self.anchor)
            self.score += weight * self._products(bits)
            rest = abs(weight) - 1
            left = qualify(self.anchor, self.score + rest * self.least[self.anchor], self.score + rest * self.most[self.anchor])
            self.anchor, self.row, self.score = self.anchor[left], self.row[left], self.score[left]

    def _products(self, bits: np.ndarray) -> np.ndarray:
        """Of a plane: sums of the anchor's components where it is set. They are below 2^53, where doubles hold all whole numbers."""
        if len(self.anchor) > FEW * len(self.a) * len(bits):
            return (self.a.astype(float) @ bits.T.astype(float))[self.anchor, self.row].astype(np.int64)
        out = np.empty(len(self.anchor), np.int64)
        step = max(1, AT_ONCE // max(1, bits.shape[1]))
        for c in range(0, len(out), step):
            out[c : c + step] = (self.a[self.anchor[c : c + step]] * bits[self.row[c : c + step]]).sum(1)
        return out


def best(pairs: Pairs, ids: np.ndarray, k: int, extra: np.ndarray | None = None) -> np.ndarray:
    """Which pairs are among the k first of their anchor (and of `extra`, a number per pair): higher scores, then smaller ids and rows."""
    group = pairs.anchor if extra is None else extra
    order = np.lexsort((pairs.row, ids[pairs.row], -pairs.score, group))
    sorted_group = group[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_group, sorted_group)
    return order[place < k]


def positives_of(anchors: dict, cands: dict, k: int, slices: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor number, candidate number, score): each anchor's k first other candidates of its label."""
    for label in np.intersect1d(anchors["label"], cands["label"]):
        at, rows = np.flatnonzero(anchors["label"] == label), np.flatnonzero(cands["label"] == label)
        some = [s[rows] for s in slices[0]]
        for c in range(0, len(at), step := max(1, AT_ONCE // len(rows))):
            own = at[c : c + step]
            pairs = Pairs(anchors["v"][own], some, slices[1], anchors["row"][own][:, None] != cands["row"][rows][None])
            pairs.run(lambda group, low, high, n=len(own): high >= kth(group, low, k, n)[group])
            top = best(pairs, cands["id"][rows], k)
            yield own[pairs.anchor[top]], rows[pairs.row[top]], pairs.score[top]


def negatives_of(anchors: dict, cands: dict, k: int, slices: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor number, number of the anchor's window, candidate number, score): each window's k first candidates of another label.

    anchors["from"], anchors["to"]: a row per anchor of its windows' limits, both included; a window whose limits are the wrong way round is none.
    """
    low_end, high_end = anchors["from"], anchors["to"]
    real = low_end <= high_end
    # Windows of one anchor widen upwards with the positive's score: the lowest has the lowest limits of all.
    lowest = np.where(real, low_end, np.iinfo(np.int64).max).min(1)
    cap = np.where(real, high_end, np.iinfo(np.int64).max).min(1)
    top_end = np.where(real, high_end, _LEAST).max(1)
    n = len(cands["row"])
    for c in range(0, len(anchors["row"]), step := max(1, AT_ONCE // n)):
        own = np.arange(c, min(c + step, len(anchors["row"])))
        own = own[real[own].any(1)]
        if not len(own):
            continue
        pairs = Pairs(anchors["v"][own], slices[0], slices[1], anchors["label"][own][:, None] != cands["label"][None])

        def qualify(group: np.ndarray, low: np.ndarray, high: np.ndarray, own: np.ndarray = own) -> np.ndarray:
            floor, ceiling = lowest[own][group], cap[own][group]
            sure = (low >= floor) & (high <= ceiling)
            limit = np.maximum(lowest[own], kth(group[sure], low[sure], k, len(own)))
            return (high >= limit[group]) & (low <= top_end[own][group])

        pairs.run(qualify)
        at, window = np.nonzero((low_end[own][pairs.anchor] <= pairs.score[:, None]) & (pairs.score[:, None] <= high_end[own][pairs.anchor]))
        pairs.anchor, pairs.row, pairs.score = pairs.anchor[at], pairs.row[at], pairs.score[at]
        top = best(pairs, cands["id"], k, pairs.anchor * low_end.shape[1] + window)
        yield own[pairs.anchor[top]], window[top], pairs.row[top], pairs.score[top]


def mine(vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", block_rows: int = 8192, anchor_rows: int = 4096) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    anchor: a predicate on vectors. low, high: a negative's score in hundredths of the positive's.
    """
    spark = vectors.sparkSession
    ship(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), label.cast("string").alias("label"), F.col(vector).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v"))).withColumn("v", integers(F.col("v"), scale))
    rows = materialize(rows.select("id", F.xxhash64("label").alias("label"), "v", F.size("v").alias("dim"), "asks", F.monotonically_increasing_id().alias("row")), "whole_vectors")
    n, asking = rows.select(F.count("*"), F.count_if("asks")).first()
    tasks, files = min(1 << 16, max(1, -(-n // block_rows))), max(1, -(-asking // anchor_rows))
    folder = new_path(spark, "anchors")
    part = F.pmod(F.xxhash64(F.lit("anchor"), "row"), F.lit(files)).cast("int").alias("part")

    def writer(name: str, windows: bool):
        def write(at: tuple, some: pd.DataFrame) -> pd.DataFrame:
            some, out, path = some.sort_values("row"), io.BytesIO(), f"{folder}/{name}-{at[0]}-{at[1]}.npz"
            held = {c: some[c].to_numpy(np.int64) for c in ("row", "id", "label")} | {"v": np.stack(some["v"].to_list()).astype(np.int64)}
            if windows:
                held |= {"from": np.ones((len(some), positives), np.int64), "to": np.zeros((len(some), positives), np.int64)}
                for i, scores in enumerate(some["scores"]):
                    s = np.asarray(scores, np.int64)
                    held["from"][i, : len(s)], held["to"][i, : len(s)] = -(-low * s // 100), high * s // 100
            np.savez(out, **held)
            put_bytes(path, out.getvalue())
            give_back()
            return pd.DataFrame({"dim": [at[0]], "path": [path]})

        return write

    def files_of(table: DataFrame, name: str, windows: bool = False) -> dict[int, list[str]]:
        """A name per file of some thousand anchors, by the vectors' length."""
        found = materialize(table.groupBy("dim", "part").applyInPandas(writer(name, windows), "dim int, path string"), f"{name}_files").collect()
        return {d: sorted(x.path for x in found if x.dim == d) for d in {x.dim for x in found}}

    def searched(paths: dict[int, list[str]], search, schema: str, names: list[str]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dim, t in blocks(batches, block_rows):
                cands = {c: t.column(c).to_numpy() for c in ("row", "id", "label")} | {"v": matrix(t.column("v").combine_chunks(), dim)}
                slices = planes(cands["v"])
                for path in paths.get(dim, []):
                    with np.load(io.BytesIO(get_bytes(path))) as f:
                        anchors = {k: f[k] for k in f.files}
                    for found in search(anchors, cands, slices):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names)
            give_back()

        return rows.drop("asks").repartition(tasks).mapInArrow(run, schema)

    def pos(anchors: dict, cands: dict, slices: tuple) -> Iterator[list[np.ndarray]]:
        for a, c, s in positives_of(anchors, cands, positives, slices):
            yield [anchors["row"][a], anchors["id"][a], cands["row"][c], cands["id"][c], s]

    def neg(anchors: dict, cands: dict, slices: tuple) -> Iterator[list[np.ndarray]]:
        for a, w, c, s in negatives_of(anchors, cands, negatives, slices):
            yield [anchors["row"][a], w, cands["row"][c], cands["id"][c], s]

    asked = rows.where("asks").select("row", "id", "label", "v", "dim", part)
    order = [F.desc("score"), F.asc("cand_id"), F.asc("cand")]
    found = searched(files_of(asked, "plain"), pos, "anchor bigint, anchor_id bigint, cand bigint, cand_id bigint, score bigint", ["anchor", "anchor_id", "cand", "cand_id", "score"])
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    opened = materialize(found.withColumn("place", place).where(F.col("place") <= positives), "positives")
    windows = opened.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("p")).select(F.col("anchor").alias("row"), F.transform("p", lambda x: x["score"]).alias("scores"))
    found = searched(files_of(asked.join(windows, "row"), "windows", True), neg, "anchor bigint, window bigint, cand bigint, cand_id bigint, score bigint", ["anchor", "window", "cand", "cand_id", "score"])
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(*order))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    named = opened.select("anchor", (F.col("place") - 1).cast("bigint").alias("window"), "anchor_id", F.col("cand_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", F.col("cand_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
