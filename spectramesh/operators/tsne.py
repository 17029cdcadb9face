"""t-SNE of any number of rows: sparse affinities of all rows, and forces from all rows in every round.

Affinities are those between each row and its 3 * perplexity nearest of all rows, as usual beyond a few thousand rows. The layout starts from an
exact one of `MARKS` rows, beside which the others are put, and then moves in rounds by the gradient over all rows: a row is pulled by its neighbours,
whose places are sent to the blocks of links, and pushed by every other row through a grid of their sums, smoothed by Fourier transforms. The driver
holds the marks and the grid, whose sides are limited; no task holds more than a block's links and a place per row.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.kernels import embed
from spectramesh.operators import blocks
from spectramesh.sources.tables import written

#: Rows of the exact layout to start from; rounds over all rows; how many of them pull more strongly.
MARKS, ROUNDS, EARLY = 1000, 30, 10
#: Rows whose links are one block; links of one written row.
ROWS, LINKS = 50_000, 1 << 20
#: Cells along a side of the grid, by the number of components; a cell is at least so wide.
SIDES, CELL = {1: 8192, 2: 384, 3: 48}, 0.25


def affinities(d2: np.ndarray, there: np.ndarray, perplexity: float, halvings: int = 60) -> np.ndarray:
    """Rows of probabilities exp(-beta d2) with the entropy of the perplexity, or that of all neighbours, if fewer."""
    d2 = d2 - np.where(there, d2, np.inf).min(1)[:, None]
    goal = np.log(np.minimum(perplexity, np.maximum(1, there.sum(1) - 1)))
    low, high, beta = np.zeros(len(d2)), np.full(len(d2), np.inf), np.ones(len(d2))
    for _ in range(halvings):
        p = np.where(there, np.exp(-d2 * beta[:, None]), 0.0)
        p /= p.sum(1, keepdims=True)
        wide = -(p * np.log(np.maximum(p, 1e-300))).sum(1) > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), np.minimum(beta * 2, 1e300), (low + high) / 2)
    return p


def _links(rows: DataFrame, n: int, perplexity: float, parts: int) -> DataFrame:
    """b, i, many, j, p: a block's links as packed arrays: rows, how many links each has, and the links. Both directions of a pair have its whole affinity."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            many = b.column("near").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = b.column("near").flatten()
            there = np.arange(int(many.max(initial=1))) < many[:, None]
            d2 = np.zeros(there.shape)
            d2[there] = flat.field("d").to_numpy(zero_copy_only=False) ** 2
            p = affinities(d2, there, perplexity)[there] / (2 * n)
            i, j = np.repeat(b.column("i").to_numpy(), many), flat.field("j").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, j)), pa.array(np.append(j, i)), pa.array(np.append(p, p))], ["i", "j", "p"])

    def pack(part: pa.Table) -> pa.Table:
        i, j, p = (part[c].to_numpy() for c in "ijp")
        order = np.lexsort((j, i))
        i, j, p = i[order], j[order], p[order]
        cuts, out = [0, *np.searchsorted(i, i[LINKS::LINKS], "right").tolist(), len(i)], []
        for a, z in itertools.pairwise(sorted(set(cuts))):
            own, many = np.unique(i[a:z], return_counts=True)
            out.append((part["b"][0].as_py(), own.tobytes(), many.tobytes(), j[a:z].tobytes(), p[a:z].tobytes()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 4], strict=True)], names=["b", "i", "many", "j", "p"])

    near = blocks.nearest_lists(rows.select(F.lit(0).alias("all"), "at", "x"), "all", "at", "x", math.ceil(3 * perplexity))
    both = near.select("i", "near").mapInArrow(told, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))
    packed = both.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(parts)).cast("int")).groupBy("b").applyInArrow(pack, "b int, i binary, many binary, j binary, p binary")
    return written(packed, "links")


def _start(rows: DataFrame, components: int, perplexity: float, seed: int) -> DataFrame:
    """at, s (place, speed, gain): beside the nearest of the rows that are laid out exactly, a little apart."""
    marks = np.array([r.x for r in rows.orderBy(F.xxhash64("at", F.lit(seed)), "at").limit(MARKS).select("x").collect()], float)
    placed = embed.tsne(marks, components, perplexity, seed)
    square, spread = (marks * marks).sum(1), 1e-3 * placed.std()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = b.column("at").to_numpy(), blocks.matrix(pa.chunked_array([b.column("x")]))[0]
            near = square - 2 * x @ marks.T
            best = np.argpartition(near, 3, 1)[:, :3]
            w = np.take_along_axis(near, best, 1)
            w = np.exp(-(w - w.min(1, keepdims=True)) / np.maximum(np.ptp(w, 1)[:, None], 1e-300))
            off = np.sin(at[:, None] * (np.arange(components) + 1.7))
            y = (placed[best] * (w / w.sum(1, keepdims=True))[:, :, None]).sum(1) + spread * off
            yield _states(b.column("at"), np.hstack([y, np.zeros_like(y), np.ones_like(y)]))

    return written(rows.select("at", "x").mapInArrow(run, "at long, s array<double>"), "places")


def _states(at: pa.Array, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([at, pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))], ["at", "s"])


def _corners(y: np.ndarray, cell: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each corner of the cells that points lie in, and the points' shares there."""
    low = np.floor(y / cell).astype(np.int64)
    part = y / cell - low
    for corner in itertools.product((0, 1), repeat=y.shape[1]):
        c = np.array(corner)
        yield low + c, np.where(c, part, 1 - part).prod(1)


def _grid(places: DataFrame, components: int, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Corners of cells and how many points they stand for."""
    names = [f"c{k}" for k in range(components)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, w = zip(*_corners(_array(b.column("s"))[:, :components], cell), strict=True)
            at, of = np.unique(np.concatenate(at), axis=0, return_inverse=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in at.T), pa.array(np.bincount(of.ravel(), np.concatenate(w)))], [*names, "w"])

    sums = places.select("s").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", w double").groupBy(*names).agg(F.sum("w").alias("w")).toArrow()
    return np.stack([sums[c].to_numpy() for c in names], 1), sums["w"].to_numpy()


def _array(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _fields(at: np.ndarray, w: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The grid's least corner, the push at its corners (a last axis of components), and the sum of 1 / (1 + d^2) over all pairs."""
    least = at.min(0)
    shape = tuple(at.max(0) - least + 1)
    held = np.zeros(shape)
    held[tuple((at - least).T)] = w
    wide, axes = tuple(2 * s for s in shape), tuple(range(len(shape)))
    way = np.meshgrid(*(np.where(np.arange(s) < s // 2, np.arange(s), np.arange(s) - s) * cell for s in wide), indexing="ij")
    q, part, cut = 1 / (1 + sum(v * v for v in way)), np.fft.rfftn(held, wide, axes=axes), tuple(slice(0, s) for s in shape)
    smooth = lambda kernel: np.fft.irfftn(part * np.fft.rfftn(kernel), wide, axes=axes)[cut]
    return least, np.stack([smooth(q * q * v) for v in way], -1), max(float((held * smooth(q)).sum() - w.sum()), 1e-12)


def large(rows: DataFrame, components: int = 2, perplexity: float = 30.0, seed: int = 42, rounds: int = ROUNDS) -> DataFrame:
    """Adds y, the layout. rows: kind, id, x. Rows without a vector, or with a null, NaN or infinite entry in it, have no place."""
    if components not in SIDES:
        raise ValueError(f"t-SNE of many rows has {min(SIDES)} to {max(SIDES)} components")
    kept = written(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    whole = kept.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).select("at", "x")
    n = whole.count()
    parts = max(12, math.ceil(n / ROWS))
    links = _links(whole, n, perplexity, parts).repartition(parts, "b").persist()
    places, cell = _start(whole, components, perplexity, seed), CELL
    for t in range(rounds):
        at, w = _grid(places, components, cell)
        if (wide := int((at.max(0) - at.min(0)).max())) > SIDES[components]:
            cell *= wide / SIDES[components] * 1.2
            at, w = _grid(places, components, cell)
        stronger, keep = (4.0, 0.5) if t < EARLY else (1.0, 0.8)
        move = _move(*_fields(at, w, cell), cell, stronger, keep, max(50.0, n / 48), components)
        sent = places.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("b"), "at", "s")
        places = written(links.groupBy("b").cogroup(sent.groupBy("b")).applyInArrow(move, "at long, s array<double>"), "places")
    links.unpersist()
    found = places.select("at", F.slice("s", 1, components).alias("y"))
    return kept.join(found.hint("merge"), "at", "left").select("kind", "id", "x", "y")


def _move(least: np.ndarray, push: np.ndarray, total: float, cell: float, stronger: float, keep: float, rate: float, components: int):
    """One round of a block's rows, by the gradient of `embed.tsne`, its speeds and gains."""

    def run(links: pa.Table, sent: pa.Table) -> pa.Table:
        at, s = sent["at"].to_numpy(), _array(sent["s"].combine_chunks())
        order = np.argsort(at)
        at, s = at[order], s[order]
        y, out = s[:, :components], []
        for k in range(links.num_rows):
            own, many, j = (np.frombuffer(links[c][k].as_buffer(), np.int64) for c in ("i", "many", "j"))
            p = np.frombuffer(links["p"][k].as_buffer(), float)
            mine = s[np.searchsorted(at, own)]
            here, speed, gain = (mine[:, c * components : (c + 1) * components] for c in range(3))
            away = np.repeat(here, many, 0) - y[np.searchsorted(at, j)]
            pull = np.add.reduceat(away * (stronger * p / (1 + (away * away).sum(1)))[:, None], np.cumsum(many) - many)
            pushed = sum(push[tuple((c - least).T)] * share[:, None] for c, share in _corners(here, cell))
            g = 4 * (pull - pushed / total)
            gain = np.maximum(np.where((g > 0) != (speed > 0), gain + 0.2, gain * 0.8), 0.01)
            speed = keep * speed - rate * gain * g
            out.append(pa.Table.from_batches([_states(pa.array(own), np.hstack([here + speed, speed, gain]))]))
        return pa.concat_tables(out) if out else pa.table({"at": pa.array([], pa.int64()), "s": pa.array([], pa.list_(pa.float64()))})

    return run
