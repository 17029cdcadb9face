"""Vector code compression with integer codebooks (operator 12).

A vector's components become floor(scale * x); the vector is cut into equal consecutive parts, and each part position has a codebook
of integer entries. In a round every part goes to its position's nearest entry (squared Euclidean distance, ties to the lower index), and
every entry that got parts becomes the floor of their mean; then all parts are assigned once more. Codebooks are broadcast: entries x
components numbers, whatever the number of rows. Arrow batches compute all distances as |x|^2 - 2 x.c + |c|^2 with an exact product, and
the first smallest one counts. A task adds up counts and sums per entry; a grouped shuffle merges them, one row per entry for the driver.

All arithmetic is exact. A product whose sums stay below 2^53 for the components at hand is taken in doubles, which hold those
numbers exactly; any other is taken in longs.

Rows whose vector is null, empty or holds a null or non-finite component are dropped. The vectors' length is that of the smallest kept id; rows
of other lengths keep no code: their code and error are null. A length that the parts don't divide raises ValueError. The first
codebooks come from the smallest ids, equal ids by their components; with fewer rows than entries there are fewer entries. Rows with a
null id are coded, but come last in that order. Null labels are one label. Components beyond 2^26 count as 2^26 with their sign. Repeated rows are
coded each for itself. An empty table gives an empty result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectramesh.llm.common import by_key, give_back, materialize, ship
from spectramesh.llm.vectors import finite, integers, matrix

#: Distances that a task holds at once.
AT_ONCE = 1 << 20


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly."""
    if a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the first of equally near ones, and its squared distance."""
    at, far, own = np.empty(len(part), np.int64), np.empty(len(part), np.int64), (book**2).sum(1)
    for c in range(0, len(part), step := max(1, AT_ONCE // len(book))):
        x = part[c : c + step]
        d = (x**2).sum(1)[:, None] + own[None] - 2 * products(x, book)
        at[c : c + step] = d.argmin(1)
        far[c : c + step] = d[np.arange(len(x)), at[c : c + step]]
    return at, far


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column per part. books: part, entry, component."""
    width = books.shape[2]
    found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(len(books))]
    return np.stack([a for a, _ in found], 1), np.stack([d for _, d in found], 1)


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the smallest ids: at most `entries` rows reach the driver."""
    head = np.array([r.v for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()], np.int64)
    if head.shape[1] % parts:
        raise ValueError(f"vectors of {head.shape[1]} components can't be cut into {parts} equal parts")
    return head.reshape(len(head), parts, -1).transpose(1, 0, 2).copy()


def next_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: assign all parts, then floor the means of the entries that got some."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            x = matrix(b.column(0), parts * width)
            codes, _ = assign(x, sent.value)
            for p in range(parts):
                np.add.at(count[p], codes[:, p], 1)
                np.add.at(total[p], codes[:, p], x[:, p * width : (p + 1) * width])
        p, e = np.nonzero(count)
        give_back()
        if len(p):
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), sums], ["part", "entry", "n", "sums"])

    told = rows.select("v").mapInArrow(tally, "part bigint, entry bigint, n bigint, sums array<bigint>")
    merged = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(j))) for j in range(width))).alias("sums"))
    out = books.copy()
    for r in merged.collect():  # a row per entry
        out[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return out


def compress(vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding") -> tuple[DataFrame, np.ndarray | None]:
    """The coded rows - id, label, codes (array<int>, a code per part), error - and the final codebooks (part, entry, component); None without rows."""
    spark = vectors.sparkSession
    ship(spark)
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(key).alias("id"), label.alias("label"), F.col(vector).alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))
    rows = materialize(rows.withColumn("v", integers(F.col("v"), scale)), "whole_vectors")
    schema = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, codes array<int>, error bigint"
    head = rows.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v")).first()
    if head is None:
        return spark.createDataFrame([], schema), None
    fit = rows.where(F.size("v") == head[0])
    books = first_books(fit, parts, entries)
    for _ in range(rounds):
        books = next_books(fit, books)
    width, sent = books.shape[2], spark.sparkContext.broadcast(books)

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy()
            good = lengths == parts * width
            codes, far = assign(matrix(b.column(2).filter(pa.array(good)), parts * width), sent.value)
            flat = pa.array(codes.astype(np.int32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(good) * parts]), pa.int32()), flat, mask=pa.array(~good)) if len(good) else pa.array([], pa.list_(pa.int32()))
            error = np.zeros(len(good), np.int64)
            error[good] = far.sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(error, mask=~good)], ["id", "label", "codes", "error"])
        give_back()

    return rows.select("id", "label", "v").mapInArrow(code, schema), books


def label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error: the sum of `error` over all rows of the label, nulls together. Sums are made before the shuffle, and a frequent label's sum is broadcast to its rows."""
    named = coded.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = materialize(named.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    return by_key(named, sums, ["_none", "_label"]).drop("_none", "_label", "n")


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The whole-number vectors that codes stand for."""
    return np.concatenate([books[p][codes[:, p]] for p in range(len(books))], axis=1)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_vectors(vectors: DataFrame, **kw) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256."""
    coded, books = compress(vectors, **kw)
    if books is not None:
        coded = materialize(coded, "codes")
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c.cast("bigint")), 2, "0"))), "")
    found = label_errors(coded)
    return found.select(F.col("id").alias("vec_id"), hexed.alias("code"), "error", "label_error", F.lit(books_digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))
