"""Approximate nearest neighbours with a vantage-point tree per shard (operator 8).

Vectors are scaled to unit length, where the Euclidean distance orders as the cosine does, and dealt by a hash of their id into
shards of about `shard_rows`. A shard's tree is built once and written to the shared folder, as the blocks of queries are; a task reads
one tree and streams the blocks through it. An inner node has a vantage point far out along the direction in which its vectors spread most,
where distances to it differ most, and halves them at the median distance. By the triangle inequality a vector is no nearer to a
query than the difference of their distances to any vantage point, so a leaf is no nearer than the largest gap, over the nodes above it, between
the query's distance and the distances on the leaf's side. Leaves whose gap exceeds `factor` times the query's k-th best distance so far are
left out; the others are scored by one matrix product each. Factor one leaves out nothing that could count and is exact.

Without a given factor each tree sets its own: some of its vectors search it, and the factor is the least that keeps RECALL of their nearest. Where
that leaves out less than WORTH of the pairs, as with vectors that spread alike in all of many directions, the tree takes factor one: nothing
is gained there by losing neighbours. The shards' best are merged by score.

Scores are computed from the original vectors in double precision, scaled by a power of two where their squares would not be finite or
normal; equal vectors get equal scores wherever they lie.

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of other lengths than a query's are none
of its candidates. Ties go to the smaller id. Rows with a query's own id are not its candidates. Rows with a null id take no
part. Empty tables give an empty result. Other columns are ignored.
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

#: Vectors of a leaf, and the numbers that a search holds at once.
LEAF, AT_ONCE = 256, 1 << 20
#: What a tree's own factor must keep, from how many of its vectors, and what share of the pairs it must leave out.
RECALL, PROBES, WORTH = 0.985, 128, 0.15
#: How far the vantage points lie outside, in radii of their vectors, and what rounding may add to a distance or a score.
OUTSIDE, ROUNDING = 3.0, 1e-7


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component to one half or more: exact, and without overflow."""
    _, e = np.frexp(np.abs(x).max(1, initial=0.0))
    return np.ldexp(x, -e[:, None])


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each sum added up from the first component to the last: the same for equal vectors wherever they lie."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def distances(unit: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Between all rows of two sets, the first of unit vectors."""
    return np.sqrt(np.maximum(0, 1 + (points * points).sum(1)[None] - 2 * (unit @ points.T)))


class Tree:
    """A vantage-point tree over unit vectors. Inner nodes are rows of `points` and `sides` (least and largest distance of the first and second half).

    paths: for each leaf the (inner node, side) pairs above it. starts: where the leaves begin. factor: the tree's own.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = 5, seed: int = 1):
        vectors = scaled(vectors)
        unit = vectors / np.sqrt(dots(vectors, vectors))[:, None]
        order, points, sides, leaves = np.arange(len(ids)), [], [], []
        rng = np.random.default_rng(seed)

        def build(a: int, b: int, above: list) -> None:
            if b - a <= LEAF:
                leaves.append((a, above))
                return
            own, half, me = unit[order[a:b]], (b - a) // 2, len(points)
            points.append(outside(own, rng))
            d = distances(own, points[me][None])[:, 0]
            turn = np.argpartition(d, half)
            order[a:b], d = order[a:b][turn], d[turn]
            sides.append([d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max()])
            build(a, a + half, [*above, (me, 0)])
            build(a + half, b, [*above, (me, 1)])

        build(0, len(ids), [])
        self.ids, self.vectors, self.unit = ids[order], vectors[order], unit[order]
        self.points, self.sides = np.array(points).reshape(-1, vectors.shape[1]), np.array(sides).reshape(-1, 4)
        self.starts = np.array([a for a, _ in leaves] + [len(ids)])
        deep = max(len(p) for _, p in leaves)
        self.paths = np.array([[*p, *[(-1, 0)] * (deep - len(p))] for _, p in leaves], np.int64).reshape(len(leaves), deep, 2)
        self.factor = self._own_factor(k, rng)

    def gaps(self, unit: np.ndarray) -> np.ndarray:
        """At least how far each leaf is from each vector."""
        out = np.zeros((len(unit), len(self.paths)))
        if len(self.points):
            d = distances(unit, self.points)
            beside = np.maximum(0, np.stack([np.maximum(self.sides[:, 2 * s] - d, d - self.sides[:, 2 * s + 1]) for s in (0, 1)], 2))
            for leaf, path in enumerate(self.paths):
                above = path[path[:, 0] >= 0]
                out[:, leaf] = beside[:, above[:, 0], above[:, 1]].max(1, initial=0)
        return out

    def _own_factor(self, k: int, rng: np.random.Generator) -> float:
        if len(self.paths) < 4:
            return 1.0
        who = rng.permutation(len(self.ids))[:PROBES]
        s = self.unit[who] @ self.unit.T
        s[np.arange(len(who)), who] = -np.inf
        near = np.argpartition(-s, k, axis=1)[:, :k]
        far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, near, 1).min(1))) + ROUNDING
        gap = self.gaps(self.unit[who]) / far[:, None]
        leaf = np.searchsorted(self.starts, near, side="right") - 1
        factor = min(1.0, float(np.quantile(np.take_along_axis(gap, leaf, 1), RECALL, method="higher")) + 1e-6)
        return factor if (gap > factor).mean() >= WORTH else 1.0

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.__dict__)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as found:
            tree.__dict__.update({k: found[k] for k in found.files})
        tree.factor = float(tree.factor)
        return tree


def outside(unit: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A point far out along the direction in which the vectors spread most (some steps of the power method, from a random start)."""
    middle = unit.mean(0)
    x = unit - middle
    way = rng.normal(size=unit.shape[1])
    for _ in range(8):
        way = x.T @ (x @ way)
        size = np.sqrt(way @ way)
        if not size > 0:  # equal vectors
            return middle
        way /= size
    return middle + OUTSIDE * np.sqrt((x * x).sum(1).max()) * way


class Search:
    """The k best of a tree for a block of queries. bounds, scored: distances to vantage points and pairs that were computed."""

    def __init__(self, tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float | None = None):
        self.t, self.k, self.query_ids = tree, k, query_ids
        self.factor = tree.factor if factor is None else factor
        self.queries = scaled(queries)
        self.norms, self.query_norms = np.sqrt(dots(tree.vectors, tree.vectors)), np.sqrt(dots(self.queries, self.queries))
        self.unit = self.queries / self.query_norms[:, None]
        self.best = np.full((len(queries), k), -np.inf)
        self.at = np.full((len(queries), k), -1)
        self.bounds, self.scored = len(queries) * len(tree.points), 0
        for c in range(0, len(queries), step := max(1, AT_ONCE // max(LEAF, len(tree.paths)))):
            self._walk(np.arange(c, min(c + step, len(queries))))

    def _walk(self, q: np.ndarray) -> None:
        """The likeliest leaf first; then every leaf for the queries that it isn't too far from."""
        gaps = self.t.gaps(self.unit[q])
        own = gaps.argmin(1)
        for leaf in np.unique(own):
            self._leaf(q[own == leaf], leaf)
        for leaf in range(gaps.shape[1]):
            last = self.best[q, -1]
            far = np.where(np.isfinite(last), np.sqrt(np.maximum(0, 2 - 2 * np.minimum(last, 1))), np.inf)
            self._leaf(q[(own != leaf) & (gaps[:, leaf] <= self.factor * far + ROUNDING)], leaf)

    def _leaf(self, q: np.ndarray, leaf: int) -> None:
        """Scores of all pairs by one product; those that could be among the best, up to rounding, are computed again in a fixed order."""
        a, b = self.t.starts[leaf], self.t.starts[leaf + 1]
        if not len(q) or a == b:
            return
        self.scored += len(q) * int(b - a)
        s = self.unit[q] @ self.t.unit[a:b].T
        s[self.query_ids[q][:, None] == self.t.ids[None, a:b]] = -np.inf
        least = self.best[q, -1]
        if b - a > self.k:
            least = np.maximum(least, np.partition(s, b - a - self.k, axis=1)[:, b - a - self.k])
        i, j = np.nonzero((s >= least[:, None] - ROUNDING) & np.isfinite(s))
        for c in range(0, len(i), step := max(1, AT_ONCE // self.queries.shape[1])):
            self._score(q[i[c : c + step]], a + j[c : c + step])

    def _score(self, q: np.ndarray, rows: np.ndarray) -> None:
        """Score pairs (q ascending) and keep each query's k best, equal scores by id."""
        score = dots(self.queries[q], self.t.vectors[rows]) / (self.query_norms[q] * self.norms[rows])
        on = score >= self.best[q, -1]
        q, rows, score = q[on], rows[on], score[on]
        who = np.unique(q)
        i, j = np.nonzero(self.at[who] >= 0)
        q, rows, score = np.concatenate([q, who[i]]), np.concatenate([rows, self.at[who][i, j]]), np.concatenate([score, self.best[who][i, j]])
        order = np.lexsort((self.t.ids[rows], -score, q))
        q, rows, score = q[order], rows[order], score[order]
        begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        top = place < self.k
        q, rows, score, place = q[top], rows[top], score[top], place[top]
        self.best[q, place], self.at[q, place] = score, rows

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, candidate ids and scores."""
        i, j = np.nonzero(self.at >= 0)
        return self.query_ids[i], self.t.ids[self.at[i, j]], self.best[i, j]


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, query: Column, k: int = 5, factor: float | None = None, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 8192, block_rows: int = 4096) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. query: a predicate on vectors that marks the query rows, by the columns key and vector.

    factor: one is exact; without it, each tree's own.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = materialize(rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")), "vectors")
    n, asking = rows.select(F.count("*"), F.count_if("asks")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asking // block_rows))
    folder = new_path(spark, "trees")

    def arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(part["id"].to_numpy(), kind="stable")
        return part["id"].to_numpy()[order], np.stack(part["v"].to_list()).astype(float)[order]

    def tree(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/shard-{name[0]}-{name[1]}.npz"
        put_bytes(path, Tree(*arrays(part), k).to_bytes())
        give_back()
        return pd.DataFrame({"dim": [name[0]], "path": [path]})

    def block(name: tuple, part: pd.DataFrame) -> pd.DataFrame:
        path, out = f"{folder}/block-{name[0]}-{name[1]}.npz", io.BytesIO()
        ids, v = arrays(part)
        np.savez(out, ids=ids, v=v)
        put_bytes(path, out.getvalue())
        return pd.DataFrame({"dim": [name[0]], "path": [path]})

    def deal(n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(n)).cast("int")

    trees = materialize(rows.select("dim", deal(shards).alias("part"), "id", "v").groupBy("dim", "part").applyInPandas(tree, "dim int, path string"), "shards")
    asked = materialize(rows.where("asks").select("dim", deal(blocks).alias("part"), "id", "v").groupBy("dim", "part").applyInPandas(block, "dim int, path string"), "blocks")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, names in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = Tree.from_bytes(get_bytes(path))
                for name in names:
                    with np.load(io.BytesIO(get_bytes(name))) as q:
                        found = Search(one, q["ids"], q["v"], k, factor).found()
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])
        give_back()

    # The stated query set against all rows, in blocks: a task has one shard's tree, and one block at a time. A name per block.
    named = asked.groupBy("dim").agg(F.sort_array(F.collect_list("path")).alias("blocks"))
    found = trees.join(F.broadcast(named), "dim").select("path", "blocks").repartition(min(shards, 1 << 16)).mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
