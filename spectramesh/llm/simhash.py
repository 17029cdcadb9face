"""SimHash near-duplicates through a Gray-order hierarchical index (operator 10).

Fingerprints that differ in at most three of 64 bits agree in one of four blocks of 16. So every distinct fingerprint is sent to
four places, each with all fingerprints that share one block's value; that is where partners are, wherever they lie. A task
sorts its fingerprints by Gray rank, so that neighbours differ in few bits, and builds an index over each block value's run:
a node holds the bits that all below it share, and only those that its parent doesn't. A search adds up the differing shared bits
on its way down and leaves a whole group as soon as they exceed the radius. Links go to the smallest member of a task's component,
so a task emits fewer links than it read fingerprints. Components follow by alternating stars.

A block value with more than `HOT` fingerprints is split once more: the other 48 bits differ in three places at most, so
partners agree in one of four parts of twelve bits. No partner is lost and none is capped.

Null, empty and blank texts have fingerprint zero and are linked like any other. Equal texts share a fingerprint; so do texts that
differ in case of A-Z or kind of blanks alone. Keys are any longs. Rows with a null key take part and come out with a null key; their
component is the smallest known key, or null if there is none. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectramesh.llm.common import BROADCAST_ROWS, by_key, chunks, give_back, materialize, row_named, scratch, ship, small, without
from spectramesh.llm.components import components

RADIUS, BLOCKS, FAN, HOT = 3, 4, 16, 200_000
_lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_hash = xxhash.xxh64_intdigest


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `words` words, repeats included; of the whole sequence if it is shorter; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_lower).split()
    n = len(found) - words + 1
    if n <= 1:
        return np.array([_hash(b" ".join(found), 42)] if found else [], np.uint64)
    line = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    begins = itertools.chain((0,), ends)
    return np.fromiter((_hash(line[a : b - 1], 42) for a, b in zip(begins, itertools.islice(ends, words - 1, None))), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes. Eight counters share a machine word for 255 hashes at a time."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    counts = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            fps = [signed(majority(shingle_hashes(t, words))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


# ---- the index ------------------------------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of a code in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Over runs of fingerprints: `group` numbers the runs, ascending; within each, fingerprints are in Gray order.

    levels[0] are the lowest nodes (FAN fingerprints at most), each higher one joins FAN nodes; the last has a node per run.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps, self.levels = fps, []
        all_of, any_of, run = fps, fps, group
        while True:
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            if self.levels and len(first) == len(run):
                break
            place = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
            begin = np.flatnonzero(place % FAN == 0)
            all_of, any_of, run = np.bitwise_and.reduceat(all_of, begin), np.bitwise_or.reduceat(any_of, begin), run[begin]
            self.levels.append({"begin": begin, "end": np.append(begin[1:], len(place)), "pattern": all_of, "mask": ~(all_of ^ any_of)})
        for low, high in itertools.pairwise(self.levels):  # what the parent holds isn't held again
            low["mask"] = low["mask"] & ~np.repeat(high["mask"], high["end"] - high["begin"])
        self.root = run

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, fingerprint number) within the radius; each query starts at the node of its run."""
        q, node, acc = np.arange(len(queries)), roots, np.zeros(len(queries), np.int64)
        for level in reversed(self.levels):
            acc = acc + np.bitwise_count((queries[q] ^ level["pattern"][node]) & level["mask"][node])
            ok = acc <= radius
            q, node, acc = q[ok], node[ok], acc[ok]
            n = level["end"][node] - level["begin"][node]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            node, q, acc = np.repeat(level["begin"][node], n) + step, np.repeat(q, n), np.repeat(acc, n)
        ok = np.bitwise_count(queries[q] ^ self.fps[node]) <= radius
        return q[ok], node[ok]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of all pairs in place: every label becomes the smallest one of its component."""
    while len(a):
        x, y = label[a], label[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:  # follow to the root
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def local_links(group: np.ndarray, fps: np.ndarray, reps: np.ndarray, radius: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of one task, as (representative, smallest representative of its component there)."""
    order = np.lexsort((gray_rank(fps), group))
    group, fps, reps = group[order], fps[order], reps[order]
    _, number = np.unique(group, return_inverse=True)
    many = np.bincount(number)[number]
    alone = many == 1
    group, fps, reps, many = number[~alone], fps[~alone], reps[~alone], many[~alone]
    if not len(fps):
        return reps, reps
    index, (_, runs) = GrayIndex(fps, group), np.unique(group, return_inverse=True)
    label, begin = np.arange(len(fps)), 0
    reach = np.cumsum(many)
    while begin < len(fps):  # as many queries at once as could meet `most` fingerprints
        end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + most)))
        q, m = index.search(fps[begin:end], runs[begin:end], radius)
        on = q + begin < m
        merge(label, q[on] + begin, m[on])
        begin = end
    # The smallest representative of each local component, by doc_id instead of place.
    root = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(root, label, reps)
    to = root[label]
    return reps[reps != to], to[reps != to]


def _part(bits_of: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(bits_of, at).bitwiseAND(F.lit((1 << bits) - 1))


def fingerprint_links(table: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """table: fp (distinct), rep (distinct). Links a, b between representatives whose fingerprints differ in `radius` bits at most.

    Every such pair is connected by the links, though not always directly.
    """
    if radius >= BLOCKS:
        raise ValueError("the blocks find partners up to three bits apart")
    width = 64 // BLOCKS
    rows = table.select("fp", "rep", F.posexplode(F.array(*(_part(F.col("fp"), width * k, width) for k in range(BLOCKS)))).alias("block", "value"))
    rows = rows.withColumn("bucket", F.col("block").cast("long") * F.lit(1 << width) + F.col("value"))
    heavy = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("bucket", F.lit(True).alias("heavy")), "hot")
    # More than `hot` rows each: a table of at most four rows per `hot` fingerprints.
    rows = rows.join(small(heavy), "bucket", "left")
    # The 48 other bits, in four parts: those above the block move down to close the gap.
    rest = F.expr(f"(fp & (shiftleft(1L, block * {width}) - 1)) | shiftleft(shiftrightunsigned(shiftrightunsigned(fp, block * {width}), {width}), block * {width})")
    part = (64 - width) // BLOCKS
    keys = F.when(F.col("heavy"), F.array(*(F.col("bucket") * F.lit(1 << (part + 2)) + F.lit(k << part) + _part(F.col("rest"), part * k, part) for k in range(BLOCKS)))).otherwise(F.array(-F.col("bucket") - 1))
    rows = rows.withColumn("rest", rest).select("fp", "rep", F.explode(keys).alias("run"))
    spark = table.sparkSession
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            fps, reps, runs = (t.column(c).to_numpy() for c in ("fp", "rep", "run"))
            a, b = local_links(runs, fps.view(np.uint64), reps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition("run").mapInArrow(run, "a bigint, b bigint").distinct()


def link_documents(docs: DataFrame, words: int = 3, radius: int = RADIUS, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    prints = materialize(fingerprints(docs, words, key, text), "prints")
    table = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    # Links are between fingerprints; only then does each component get its smallest key, whatever range the keys have.
    table = materialize(table.withColumn("rep", F.col("fp")), "table")
    found = materialize(components(fingerprint_links(table.select("fp", "rep"), radius, hot)), "found")
    linked = materialize(table.join(found, F.col("rep") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("component", "rep").alias("c")), "classes")
    smallest = materialize(linked.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "smallest")
    named = materialize(by_key(linked.select("fp", F.col("n").alias("rows"), "c"), smallest, ["c"]).select("fp", F.col("rows").alias("n"), "component_id"), "named")
    return by_key(prints, named, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near-duplicates by shingle similarity --------------------------------------------------------------------------

#: A shingle in more prefixes than this is common and comes last in every document's order.
COMMON = 64


def _mixed(words: list[bytes], memo: dict[bytes, int], n: int) -> np.ndarray:
    """Distinct hashes of the runs of n words (of the whole sequence, if shorter)."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(memo) > 200_000:
        memo.clear()
    for w in set(words):
        if w not in memo:
            memo[w] = _hash(w, 7)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def as_longs(hashes: np.ndarray) -> np.ndarray:
    """Unsigned hashes as longs in the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def reach(n: int, similarity: float) -> int:
    """How many of n shingles, in an order that all documents share, hold at least one of any set that is `similarity` alike.

    Alike sets share at least similarity * n of the n, so those can't all lie beyond the first n - ceil(similarity * n) + 1.
    """
    return n - math.ceil(similarity * n - 1e-9) + 1


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two longs that equal sets share; other sets do with a chance of 2^-128."""
    with np.errstate(over="ignore"):
        mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return signed(int(hashes.sum(dtype=np.uint64))), signed(int((mixed ^ (mixed >> np.uint64(32))).sum(dtype=np.uint64)))


#: Counters of a document's shingles, shingles that share a fine counter, and the documents of a class that meet those of another block (or their own) in one cell.
COUNTERS, SHARED, CELL = 256, 16, 512


def _counters(hashes: np.ndarray, n: int) -> np.ndarray:
    """How many shingles fall to each counter, a byte each; all at 255 if one of them doesn't fit, so that nothing is ruled out.

    Two documents share at most the sum of their smaller counters.
    """
    found = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % n, minlength=n)
    return (found if found.max() < 256 else np.full(n, 255)).astype(np.uint8)


def shingle_counts(hashes: np.ndarray) -> bytes:
    return _counters(hashes, COUNTERS).tobytes()


def fine_counts(hashes: np.ndarray) -> bytes:
    """The number of shingles, and a counter for every SHARED of them or so: a power of two, so that those of a longer document fold to those of a shorter."""
    return np.array([len(hashes)], "<i4").tobytes() + _counters(hashes, max(COUNTERS, 1 << (len(hashes) // SHARED).bit_length())).tobytes()


def may_be_alike(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two documents can be `similarity` alike by their fine counters."""
    (n,), (m,) = np.frombuffer(x, "<i4", 1), np.frombuffer(y, "<i4", 1)
    a, b = np.frombuffer(x, np.uint8, offset=4), np.frombuffer(y, np.uint8, offset=4)
    size = min(len(a), len(b))
    shared = min(int(np.minimum(a.reshape(-1, size).sum(0, dtype=np.int64), b.reshape(-1, size).sum(0, dtype=np.int64)).sum()), int(n), int(m))
    return shared >= similarity * (int(n) + int(m) - shared) - 1e-9


def crossing(docs: np.ndarray, parts: np.ndarray, side: np.ndarray, counts: np.ndarray, sizes: np.ndarray, similarity: float, best: bool) -> list[tuple[int, int]]:
    """Pairs of one cell that lie in different components and may be `similarity` alike by their counters; with `best` each document's likeliest only.

    side: 0 or 1, the block; documents of one side meet in the cell of that block alone, where all are of side 0.
    """
    order = np.arange(len(docs))
    both_sides, out = bool(side.any()), []
    for i in range(len(docs)):
        ok = (parts != parts[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]) - 1e-9)
        ok &= (side != side[i]) if both_sides else (order != i)
        if not best:
            ok &= order > i
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        shared = np.minimum(np.minimum(counts[at], counts[i]).sum(1, dtype=np.int64), np.minimum(sizes[at], sizes[i]))
        bound = shared - similarity * (sizes[at] + sizes[i] - shared)
        on = np.flatnonzero(bound >= -1e-9)
        if best and len(on):
            on = on[[int(np.lexsort((docs[at[on]], -bound[on]))[0])]]
        out += [(int(max(docs[i], docs[j])), int(min(docs[i], docs[j]))) for j in at[on]]
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays]), kind))


def _beside(pairs: DataFrame, side: str, held: DataFrame, name: str, most: int) -> DataFrame:
    """pairs with what `held` has of the document named by `side`, as `name`; one that is in many pairs is sent to as many places as it takes."""
    limit = max(CELL, pairs.count() // most)
    many = pairs.groupBy(side).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    # Fewer than `most` documents can have that many pairs.
    many = F.broadcast(materialize(many.select(side, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), "many"))
    parts = F.coalesce("_parts", F.lit(1))
    sent = held.select(F.col("doc_id").alias(side), F.col("held").alias(name)).join(many, side, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    dealt = pairs.join(many, side, "left").withColumn("_part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("_parts")
    return dealt.join(sent, [side, "_part"]).drop("_part")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text", rounds: int = 2, common: int = COMMON, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, component_id of the documents that have a near-duplicate: Jaccard similarity of their word shingles of `similarity` or more.

    Keys are distinct longs; rows with a null key take no part. Documents with equal sets of shingles (the empty set too) are one from the start.
    Candidates are all pairs of a class. A class is the documents with one shingle among their first `reach`, in the order of the
    shingles' hashes with common shingles last: whatever shingles are called common, every pair of the given similarity shares such
    a class. The documents whose fingerprints the Gray-order index (radius three) puts into one component are a class besides.

    First each document is compared with its class's pivot, the document with most company; in the other `rounds`, classes with several
    components left compare each document with the likeliest one of another component. In the end all pairs of a class that are not
    in one component by then are compared, in cells of blocks of CELL documents, but for those whose sizes or counters
    rule the similarity out. So no pair of that similarity is left in two components. Each comparison is exact over all shingles.
    """
    with scratch(docs.sparkSession):
        return materialize(_near_duplicates(docs, words, similarity, key, text, rounds, common, most), "near", keep=True)


def _near_duplicates(docs: DataFrame, words: int, similarity: float, key: str, text: str, rounds: int, common: int, most: int) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def made(b: pa.RecordBatch, memo: dict[bytes, int]) -> list[np.ndarray]:
        return [_mixed((t or "").encode("utf-8", "surrogatepass").translate(_lower).split(), memo, words) for t in b.column(1).to_pylist()]

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for b in chunks(batches):
            found = made(b, memo)
            marks = [digest(h) for h in found]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array([signed(majority(h)) for h in found], pa.int64()), pa.array([x for x, _ in marks], pa.int64()), pa.array([y for _, y in marks], pa.int64()),
                    pa.array([len(h) for h in found], pa.int32()), _lists([as_longs(h[: reach(len(h), similarity)]) for h in found], pa.int64()), pa.array([shingle_counts(h) for h in found], pa.binary()),
                    pa.array([fine_counts(h) for h in found], pa.binary()),
                ],
                ["doc_id", "fp", "d1", "d2", "size", "keys", "counts", "fine"],
            )

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(h >> np.uint64(16)).astype("<u8").tobytes() for h in made(b, memo)], pa.binary())], ["doc_id", "held"])

    def ruled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([may_be_alike(x, y, similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
        give_back()

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9 or not len(x) or not len(y):
                    ok.append(False)
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])
        give_back()

    def meet(best: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                t = pa.Table.from_batches(held)
                k, lo, hi, ids, parts, block, sizes = (t.column(c).to_numpy() for c in ("k", "lo", "hi", "doc_id", "c", "block", "size"))
                counts = np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).reshape(-1, COUNTERS)
                order = np.lexsort((ids, hi, lo, k))
                k, lo, hi = k[order], lo[order], hi[order]
                begin = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
                for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(k)], strict=True):
                    at = order[x:y]
                    found = crossing(ids[at], parts[at], (block[at] != lo[x]).astype(np.int8), counts[at], sizes[at].astype(np.int64), similarity, best) if y - x > 1 and (lo[x] == hi[x] or len(np.unique(block[at])) > 1) else []
                    if found:
                        a, b = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            give_back()

        return run

    def faced(pairs: DataFrame, held: DataFrame) -> DataFrame:
        return _beside(_beside(pairs, "a", held, "x", most), "b", held, "y", most).select("a", "b", "x", "y")

    def alike(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are near-duplicates: by their fine counters first, then by all shingles."""
        pairs = materialize(faced(pairs, fine).mapInArrow(ruled, "a bigint, b bigint"), "likely")
        named = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "named")
        full = materialize(texts.join(small(named), "doc_id", "left_semi").mapInArrow(sets, "doc_id bigint, held binary"), "shingles")
        return materialize(faced(pairs, full).mapInArrow(compare, "a bigint, b bigint"), "links")

    marks = materialize(texts.mapInArrow(sketch, "doc_id bigint, fp bigint, d1 bigint, d2 bigint, size int, keys array<bigint>, counts binary, fine binary"), "sketches")
    fine = marks.select("doc_id", F.col("fine").alias("held"))
    # Copies: of each set of shingles the smallest key stands for all.
    groups = materialize(marks.groupBy("d1", "d2", "size").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "groups")
    copies = materialize(by_key(marks.select("doc_id", "d1", "d2", "size"), groups, ["d1", "d2", "size"], most=most).where("doc_id <> rep").select("doc_id", "rep"), "copies")
    single = marks.join(small(copies.select("doc_id"), most), "doc_id", "left_anti")
    # Classes by a shingle of the prefix. Where one is common, the documents that began with it begin with others.
    first = single.where("size > 0").select("doc_id", F.explode("keys").alias("k"))
    often = materialize(first.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > common), "common")
    # Of a longer list those with more than a `most`-th of all rows: fewer than `most` of them, eight bytes each.
    limit = 0 if often.limit(most + 1).count() <= most else single.agg(F.sum(F.size("keys"))).first()[0] // most
    often = often.where(F.col("n") > limit)
    late = np.sort(often.select("k").toArrow().column("k").to_numpy())
    if len(late):
        sent = spark.sparkContext.broadcast(late)
        moved = materialize(by_key(first, often, ["k"], most=most).select("doc_id").distinct(), "moved")

        def again(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo: dict[bytes, int] = {}
            late = sent.value
            for b in chunks(batches):
                out = []
                for h in map(as_longs, made(b, memo)):
                    last = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                    out.append(np.concatenate([h[~last], h[last]])[: reach(len(h), similarity)])
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(out, pa.int64())], ["doc_id", "keys"])

        other = texts.join(small(moved, most), "doc_id", "left_semi").mapInArrow(again, "doc_id bigint, keys array<bigint>").select("doc_id", F.explode("keys").alias("k"))
        first = materialize(first.join(small(moved, most), "doc_id", "left_anti").unionByName(other), "prefixes")
    # The documents of an index component are a class of their own; most fingerprints are alone in theirs and need no row.
    prints = materialize(single.where("size > 0").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "prints")
    index = materialize(components(fingerprint_links(prints.select("fp", "rep")), most=most), "index")
    family = prints.join(small(index, most), F.col("rep") == F.col("node"), "left").select("fp", F.xxhash64(F.lit("family"), F.coalesce("component", "rep")).alias("k"), F.col("node").isNotNull().alias("linked"), "n")
    family = materialize(family.where("linked or n > 1").select("fp", "k", "n"), "families")
    rows = first.unionByName(by_key(single.where("size > 0").select("doc_id", "fp"), family, ["fp"], most=most).select("doc_id", "k"))
    shared = materialize(rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = materialize(by_key(rows, shared, ["k"], most=most).select("k", "doc_id"), "company")
    # Classes of the same documents are one class.
    sized = rows.groupBy("k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("s2"))
    sizes = materialize(sized.groupBy("n", "s1", "s2").agg(F.min("k").alias("k")).select("k", "n"), "classes")
    rows = materialize(by_key(rows, sizes, ["k"], most=most).select("k", "doc_id", "n"), "company")
    popular = rows.groupBy("doc_id").agg(F.sum("n").alias("company"))
    ranked = materialize(rows.join(popular, "doc_id").join(marks.select("doc_id", "size"), "doc_id").select("k", "n", "doc_id", "size", "company"), "ranked")
    pivots = ranked.groupBy("k", "n").agg(F.max(F.struct("company", (-F.col("doc_id")).alias("m"), "size")).alias("p"))
    pivots = materialize(pivots.select("k", "n", (-F.col("p.m")).alias("pivot"), F.col("p.size").alias("other")), "pivots")
    likely = F.least("size", "other") >= F.greatest("size", "other") * similarity - 1e-9
    met = by_key(ranked.select("k", "doc_id", "size"), pivots, ["k"], most=most).where(F.col("doc_id") != F.col("pivot")).where(likely)
    tested = materialize(met.select(F.greatest("doc_id", "pivot").alias("a"), F.least("doc_id", "pivot").alias("b")).distinct(), "pairs")
    links = alike(tested)
    for turn in range(max(1, rounds)):
        parts = materialize(components(links, most=most), "parts")
        placed = materialize(rows.join(small(parts, most), F.col("doc_id") == F.col("node"), "left").select("k", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")), "placed")
        still = materialize(placed.groupBy("k", "n").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("k", "n"), "open")
        blocks = F.ceil(F.col("n") / CELL).cast("int")
        cells = by_key(placed.drop("n"), still, ["k"], most=most).withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int")).withColumn("blocks", blocks)
        cells = cells.join(marks.select("doc_id", "counts", "size"), "doc_id").select("k", "doc_id", "c", "block", "counts", "size", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cells = cells.select("k", "doc_id", "c", "block", "counts", "size", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        found = cells.repartition("k", "lo", "hi").mapInArrow(meet(turn + 1 < rounds), "a bigint, b bigint").distinct()
        found = materialize(found.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(alike(found))
        tested = tested.unionByName(found)
    found = materialize(components(links, most=most), "components")
    # Copies follow the document that stands for them.
    groups = groups.join(found, F.col("rep") == F.col("node"), "left").select("rep", "n", F.coalesce("component", "rep").alias("component_id"), F.col("node").isNull().alias("alone"))
    groups = materialize(groups, "groups")
    rest = by_key(copies, groups, ["rep"], most=most).select("doc_id", "component_id").unionByName(groups.where("alone").select(F.col("rep").alias("doc_id"), "component_id"))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id")).unionByName(rest)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates and of each group the one with the smallest key, columns as they are.

    Rows with a null key stay. Rows that repeat a key are told apart by their texts: those that aren't near-duplicates all stay, and of
    those that are, with the same smallest key, the one whose text has the smallest hash (of equal texts the first one read).
    """
    some, keys = docs.select(F.count(key), F.count_distinct(key)).first()
    if some == keys:
        found = near_duplicates(docs, words, similarity, key, text)
        return without(docs, materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")), "duplicates"), key)
    numbered, at = row_named(docs, key)
    known = numbered.where(F.col(key).isNotNull()).select(F.col(at).alias("_at"), F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"))
    found = near_duplicates(numbered.where(F.col(key).isNotNull()).select(at, text), words, similarity, at, text).join(known, F.col("doc_id") == F.col("_at"))
    found = materialize(found.select("component_id", F.struct("_key", "_hash", "_at").alias("place")), "places")
    stays = materialize(found.groupBy("component_id").agg(F.min("place").alias("least"), F.count("*").alias("n")), "stays")
    gone = by_key(found, stays, ["component_id"]).where(F.col("place") != F.col("least")).select(F.col("place._at").alias("_gone"))
    return without(numbered, materialize(gone, "duplicates"), at).drop(at)
