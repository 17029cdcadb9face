"""Document fingerprints by a homomorphic multiset hash of paragraphs (operator 13).

A paragraph's vector has `WIDE` lanes from a hash of the whole paragraph and `SKETCH` lanes that add up, over its runs of five words, plus
or minus one by a bit of the run's hash. A document's fingerprint is the sum of its paragraphs' vectors modulo 2^16 in each lane. So it
doesn't depend on the paragraphs' order, texts with the same paragraphs have the same fingerprint, and putting a paragraph in or taking
one out adds or subtracts one vector: `insert` and `delete` never see the rest of the text. The wide lanes tell texts apart; the sketch lanes
keep inner products of the counts of runs up to an error of about 1 / sqrt(SKETCH), and `likeness` is the cosine that they give.

The query edits each text's end by the start of the next document's. Documents go by key into ranges - one shuffle of the texts - and a task
streams its range in order; only the first and the last text of each range meet in a second step. The edited text's fingerprint comes from the
text's own one: the paragraphs behind the cut are deleted, those of the new end are inserted.

Paragraphs are the parts between newlines, as they are, empty ones included; a null or empty text has none and the zero fingerprint.
Paragraphs of fewer than twelve words are taken by runs
of five bytes, and words of more than 32 bytes by pieces of 32. Lanes hold up to 32,767 more pluses than minuses; a text that repeats one run more often than that has
a defined but arbitrary likeness to others, while equality stays right. Documents follow each other by key, null keys first,
equal keys by a hash of their text and then by the text; after the last comes the first, and the only one follows itself. An empty table gives an empty
result. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.llm.common import chunks, give_back, materialize, ship

#: Lanes of 16 bits.
WIDE, SKETCH, RUN = 64, 128, 5
#: Words up to which a paragraph is short, bytes of the runs of a short one, and of a word that counts as one.
SHORT, PIECE, LONG = 12, 5, 32
#: Bytes of text that a task of the ordered pass streams, and hashes of runs that it unpacks at once.
TASK_BYTES, AT_ONCE = 128 << 20, 1 << 15
#: Words whose hashes a worker keeps.
MEMO = 200_000
_memo: dict[bytes, int] = {}


def paragraphs(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    """A finalizer of 64 bits: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(line: bytes) -> list[bytes]:
    """Words between blanks; one of more than `LONG` bytes is cut into pieces of that size."""
    found = line.split()
    if len(line) > LONG and max(map(len, found), default=0) > LONG:
        found = [w[i : i + LONG] for w in found for i in range(0, len(w), LONG)]
    return found


def runs(lines: list[bytes]) -> np.ndarray:
    """A hash for every run of five words inside a paragraph; in a short paragraph, for every run of five bytes."""
    words: list[bytes] = []
    ends: list[int] = []
    short: list[int] = []
    for line in lines:
        found = words_of(line)
        if len(found) < SHORT:
            text = b" ".join(line.split())
            short += [xxhash.xxh64_intdigest(text[i : i + PIECE], 17) for i in range(max(1, len(text) - PIECE + 1))] if text else []
        else:
            words += found
            ends.append(len(words))
    few = _mix(np.array(short, np.uint64))
    if not words:
        return few
    if len(_memo) > MEMO:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = xxhash.xxh64_intdigest(w, 13)
    h = np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(h) - RUN + 1, np.uint64)
    for j in range(RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - RUN + 1 + j]
    counts = np.diff(ends, prepend=0)
    room = np.repeat(ends, counts) - np.arange(len(h)) >= RUN  # the run ends in its paragraph
    return np.concatenate([_mix(out[room[: len(out)]]), few])


def signs(hashes: np.ndarray) -> np.ndarray:
    """For each sketch lane, how many hashes have its bit set less how many haven't. Eight counters share a machine word for 255 hashes at a time."""
    total = np.zeros(SKETCH, np.int64)
    for c in range(0, len(hashes), AT_ONCE):
        h = hashes[c : c + AT_ONCE]
        wide = np.stack([_mix(h + np.uint64(k)) for k in range(SKETCH // 64)], 1).astype("<u8")
        bits = np.unpackbits(wide.view(np.uint8), bitorder="little").view(np.uint64).reshape(len(h), -1)
        total += np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, SKETCH).sum(0, dtype=np.int64)
    return 2 * total - len(hashes)


def vector(some: list[str]) -> np.ndarray:
    """The sum of the paragraphs' vectors: unsigned 16-bit lanes, the wide ones first."""
    lines = [p.encode("utf-8", "surrogatepass") for p in some]
    wide = b"".join(hashlib.blake2b(x, digest_size=64, person=bytes([k])).digest() for x in lines for k in range(WIDE // 32))
    whole = np.frombuffer(wide, "<u2").reshape(-1, WIDE).sum(0, dtype=np.int64)
    return (np.concatenate([whole, signs(runs(lines))]) & 0xFFFF).astype("<u2")


def fingerprint(text: str | None) -> np.ndarray:
    return vector(paragraphs(text))


def insert(print_: np.ndarray, some: list[str]) -> np.ndarray:
    """The fingerprint with paragraphs put in, wherever they are put."""
    return print_ + vector(some)


def delete(print_: np.ndarray, some: list[str]) -> np.ndarray:
    """The fingerprint with paragraphs taken out. The text must have held them."""
    return print_ - vector(some)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints; else the cosine of the texts' counts of runs as the sketch lanes give it, within 0 and 1."""
    if (a == b).all():
        return 1.0
    x, y = (p[WIDE:].view("<i2").astype(float) for p in (a, b))
    size = float(x @ x) * float(y @ y)
    return min(1.0, max(0.0, float(x @ y) / size**0.5)) if size else 0.0


def edited(text: str, after: str) -> tuple[str, int]:
    """The text with its last quarter of code points replaced by the first as many of the next one, and where the first paragraph that changes begins."""
    cut = len(text) - len(text) // 4
    return text[:cut] + after[: len(text) // 4], text.rfind("\n", 0, cut) + 1


def compare(text: str, print_: np.ndarray, after: str, next_print: np.ndarray) -> tuple:
    """n_chars, edited_sha256, both fingerprints as bytes, both likenesses."""
    new, begin = edited(text, after)
    changed = insert(delete(print_, text[begin:].split("\n")), new[begin:].split("\n")) if new != text else print_
    return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), print_.tobytes(), changed.tobytes(), likeness(print_, changed), likeness(print_, next_print)


_MADE = "n_chars bigint, edited_sha256 string, print binary, edited binary, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "print", "edited", "near_edited", "near_next"]


def _batch(lead: list[tuple[str, pa.DataType, list]], made: list[tuple | None]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    cols = [pa.array([m and m[k] for m in made], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, t, v in lead] + cols, [n for n, _, _ in lead] + _NAMES)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next of every document."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    order = [F.asc_nulls_first("key"), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order, "text").select(F.spark_partition_id().alias("part"), "key", "text")

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 'pair' are finished; a task's first and last text come out with their texts."""
        held = None
        for b in chunks(batches):
            out: list[tuple[str, int, int | None, str | None, tuple | None]] = []
            for part, k, t in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                print_ = held[3] if held and held[2] == t else fingerprint(t)
                out.append(("pair", held[0], held[1], None, compare(held[2], held[3], t, print_)) if held else ("first", part, k, t, None))
                held = (part, k, t, print_)
            kinds, parts, keys, texts, made = zip(*out, strict=True)
            yield _batch([("kind", pa.string(), kinds), ("part", pa.int32(), parts), ("key", pa.int64(), keys), ("text", pa.string(), texts)], made)
        if held:
            yield _batch([("kind", pa.string(), ["last"]), ("part", pa.int32(), [held[0]]), ("key", pa.int64(), [held[1]]), ("text", pa.string(), [held[2]])], [None])

    found = materialize(ranged.mapInArrow(stream, f"kind string, part int, key bigint, text string, {_MADE}"), "fingerprints")
    # A number per task that had rows: each one's last text meets the first text of the next one.
    parts = sorted(r.part for r in found.where(F.col("kind") == "last").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    last = found.where(F.col("kind") == "last").select("part", "key", "text").join(F.broadcast(after), "part")
    first = found.where(F.col("kind") == "first").select(F.col("part").alias("next"), F.col("text").alias("after"))

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, nexts = (b.column(c).to_pylist() for c in range(3))
            if keys:
                yield _batch([("key", pa.int64(), keys)], [compare(t, fingerprint(t), n, fingerprint(n)) for t, n in zip(texts, nexts, strict=True)])
        give_back()

    ends = last.join(first, "next").select("key", "text", "after").mapInArrow(close, f"key bigint, {_MADE}")
    done = found.where(F.col("kind") == "pair").select("key", *_NAMES).unionByName(ends)
    return done.select(F.col("key").alias("doc_id"), "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next")
