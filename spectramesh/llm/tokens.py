"""Token ids: encoding of whole texts, and files of raw ids with a minimal perfect hash index (operator 2).

File of one shard part, little-endian throughout:

    magic "SMTK0001" | uint32 header length | JSON header | sections, each at a multiple of 8 bytes

The header gives for each section its offset, dtype and length. Sections: `payload` (the ids, uint16 where the
vocabulary allows it, else uint32), `keys` (int64, ascending), `starts` (int64, one more than keys: first id of each document),
and the index: `bits` and `ranks` (the levels of the minimal perfect hash, with a rank for every 512 bits),
`rest` (keys that no level placed), `prints` (uint32 fingerprint of the key at each slot) and `slots`
(uint32 position of the slot's key among `keys`). A look-up reads one bit per level, one rank, one fingerprint and
one slot, however many keys there are.
"""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectramesh.llm.common import bucket, chunks, get_bytes, get_range, idle, materialize, new_path, put_bytes, range_bounds, running, ship

MAGIC = b"SMTK0001"
#: Distinct words whose ids a worker remembers between chunks (about 90 MB); past it those that came up once are forgotten.
MEMO_WORDS = 400_000
#: Seconds after which a worker that does other work lets its encoders go.
IDLE = 20
#: Ids in one file: 32 MB at two bytes each. It bounds what a writer or reader holds.
FILE_TOKENS = 16 << 20
KEYS_PER_BIT_LEVELS = 24


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    The vocabulary file's pre-tokenizer never joins characters across a blank, and its normalizer works on single
    characters of Latin-1. So such texts are cut at blanks, and equal pieces are encoded once in a worker. All other
    texts, and those that may hold a special token's string, are encoded directly.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.loads(self.tokenizer.to_str())
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        suffix = spec["model"].get("end_of_word_suffix")
        steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        blanks = [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
        # What all special tokens begin with, or each of them.
        special = [x["content"].lower() for x in spec.get("added_tokens", [])]
        self.marks = [begin] if (begin := os.path.commonprefix(special)) else special
        self.upper = [x.upper() for x in self.marks]
        splits = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split" and x["invert"] and x["behavior"] == "Removed"]
        self.by_word = bool(suffix) and steps == blanks and len(splits) == 1
        if self.by_word:
            self.pieces = regex.compile(splits[0]["pattern"]["Regex"]).findall
            self.last = np.zeros(self.size, bool)
            self.last[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.memo: dict[str, bytes] = {"": b""}
        self.hot: set[str] = set()

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        """Whether a text can be cut at blanks: Latin-1 and no special token."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        low = text if self.marks == self.upper else text.lower()
        return not any(x in low for x in self.marks)

    def _learn(self, words: list[str]) -> None:
        """Put words into the memo: each as its pre-tokens, which are encoded many at a time."""
        memo, need, compound = self.memo, set(), []
        for w in words:
            if w.isalpha():
                need.add(w)
            else:
                parts = (w[:-1], w[-1]) if w[-1] in ",." and w[:-1].isalpha() else self.pieces(w)
                compound.append((w, parts))
                need.update(parts)
        new = list(need.difference(memo))
        for at in range(0, len(new), 512):
            some = new[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(some):
                memo.update(zip(some, self.direct(some), strict=True))
                continue
            raw, begin = ids.tobytes(), 0
            for p, end in zip(some, ends.tolist(), strict=True):
                memo[p] = raw[begin:end]
                begin = end
        for w, parts in compound:
            memo[w] = b"".join([memo[p] for p in parts])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of self.dtype."""
        _last[0] = time.monotonic()
        if not self.by_word:
            return self.direct(texts)
        words = [t.replace("\n", " ").lower().split(" ") if self._plain(t) else None for t in texts]
        odd = [i for i, w in enumerate(words) if w is None]
        distinct = set().union(*(w for w in words if w is not None))
        if len(self.memo) > MEMO_WORDS:  # keep what came up again since the last time, if that helps
            self.memo = {"": b""} | ({w: self.memo[w] for w in self.hot} if len(self.hot) < MEMO_WORDS // 2 else {})
            self.hot = set()
        missing = distinct.difference(self.memo)
        self.hot |= distinct - missing
        self._learn(list(missing))
        get = self.memo.__getitem__
        out = [b"".join(map(get, w)) if w is not None else b"" for w in words]
        if odd:
            for i, ids in zip(odd, self.direct([texts[i] for i in odd]), strict=True):
                out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}
_last = [0.0]


def _forget() -> None:
    if time.monotonic() - _last[0] > IDLE:
        _encoders.clear()


idle.append(_forget)


def encoder(file: str) -> Encoder:
    """One for each file and worker process, so that tasks share its memo."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def encode(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, ids (binary, little-endian), part and start_in_part.

    Null text counts as empty; `end_id` is appended to every document. part is the task's number and
    start_in_part the ids of the task's documents before this one, for prefix sums over tasks.
    """
    ship(docs.sparkSession)
    schema = "key bigint, n_tokens int, ids binary, part int, start_in_part bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for b in chunks(batches):
            ids = [x + end for x in enc([t or "" for t in b.column(1).to_pylist()])]
            n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
            starts = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), pa.array(ids, pa.binary()), pa.array(np.full(len(n), part, np.int32)), pa.array(starts)], ["key", "n_tokens", "ids", "part", "start_in_part"])

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


# ---- minimal perfect hash -------------------------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer: multiply and shift until every bit of the key reaches every bit of the hash."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _fit(keys: np.ndarray, gamma: float = 2.0) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Levels of bit sets: a key stays at the first level where no other remaining key hits its bit."""
    bits, sizes, left = [], [], keys
    for level in range(KEYS_PER_BIT_LEVELS):
        if not len(left):
            break
        m = max(64, int(np.ceil(gamma * len(left) / 64)) * 64)
        at = (_mix(left, level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        bits.append(np.packbits(alone, bitorder="little"))
        sizes.append(m)
        left = left[~alone[at]]
    return np.concatenate(bits) if bits else np.zeros(0, np.uint8), sizes, left


class KeyIndex:
    """Slots 0..n-1 of n distinct keys, and a fingerprint per slot that tells absent keys (but 1 in 2^32)."""

    def __init__(self, bits: np.ndarray, sizes: list[int], ranks: np.ndarray, rest: np.ndarray, prints: np.ndarray, slots: np.ndarray):
        self.bits, self.sizes, self.ranks, self.rest, self.prints, self.slots = bits, sizes, ranks, rest, prints, slots

    @classmethod
    def build(cls, keys: np.ndarray) -> KeyIndex:
        """keys: distinct int64. Its slots map to positions in `keys`."""
        bits, sizes, left = _fit(keys)
        padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        per = np.bitwise_count(padded).reshape(-1, 64).sum(1, dtype=np.int64)
        index = cls(bits, sizes, (np.cumsum(per) - per).astype(np.uint32), np.sort(left), np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32))
        at = index._slot(keys)
        index.prints[at] = (_mix(keys, 97) >> np.uint64(32)).astype(np.uint32)
        index.slots[at] = np.arange(len(keys), dtype=np.uint32)
        return index

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """-1: in no level and not among the rest."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_mix(keys[open_], level) % np.uint64(m)).astype(np.int64) + base
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            got, to = at[hit], open_[hit]
            out[to] = self._rank(got)
            open_, base = open_[~hit], base + m
        if len(open_) and len(self.rest):
            j = np.searchsorted(self.rest, keys[open_])
            ok = (j < len(self.rest)) & (self.rest[np.minimum(j, len(self.rest) - 1)] == keys[open_])
            out[open_[ok]] = len(self.prints) - len(self.rest) + j[ok]
        return out

    def _rank(self, at: np.ndarray) -> np.ndarray:
        """Bits that are set before each position: the block's rank and at most 63 bytes and 7 bits besides."""
        block, byte = at >> 9, at >> 3
        out = self.ranks[block].astype(np.int64)
        for step in range(64):
            b = (block << 6) + step
            on = b < byte
            if not on.any():
                break
            out[on] += np.bitwise_count(self.bits[b[on]])
        return out + np.bitwise_count(self.bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key among the sorted distinct keys, or -1."""
        keys = np.asarray(keys, np.int64)
        at = self._slot(keys)
        ok = at >= 0
        ok[ok] = self.prints[at[ok]] == (_mix(keys[ok], 97) >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.slots[at[ok]]
        return out


# ---- files ----------------------------------------------------------------------------------------------------------


def file_bytes(keys: np.ndarray, lengths: np.ndarray, payload: bytes, dtype: np.dtype, null_keys: bool = False) -> bytes:
    """keys ascending; repeated ones are kept in the payload, and the index leads to the first. null_keys: zeros that stand for null."""
    distinct, first = np.unique(keys, return_index=True)
    index = KeyIndex.build(distinct)
    sections = {
        "keys": keys.astype("<i8"), "starts": np.concatenate([[0], np.cumsum(lengths)]).astype("<i8"), "first": first.astype("<u4"), "bits": index.bits,
        "ranks": index.ranks, "rest": index.rest.astype("<i8"), "prints": index.prints, "slots": index.slots,
    }
    layout, at = {}, 0
    blobs = [(k, v.dtype.str, v.tobytes()) for k, v in sections.items()] + [("payload", dtype.str, payload)]
    for k, kind, raw in blobs:
        layout[k] = {"at": at, "dtype": kind, "bytes": len(raw)}
        at += -(-len(raw) // 8) * 8
    head = json.dumps({"sections": layout, "sizes": index.sizes, "documents": len(keys), "null_keys": null_keys}).encode()
    head += b" " * (-(len(MAGIC) + 4 + len(head)) % 8)
    return b"".join([MAGIC, np.array([len(head)], "<u4").tobytes(), head, *(raw + bytes(-len(raw) % 8) for _, _, raw in blobs)])


class TokenFile:
    """A file of ids, opened by its bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(data, "<u4", 1, 8)[0])
        head, base = json.loads(data[12 : 12 + n]), 12 + n
        self.null_keys = head["null_keys"]
        part = {k: np.frombuffer(data, np.dtype(x["dtype"]), x["bytes"] // np.dtype(x["dtype"]).itemsize, base + x["at"]) for k, x in head["sections"].items()}
        self.keys, self.starts, self.first, self.payload = part["keys"], part["starts"], part["first"], part["payload"]
        self.index = KeyIndex(part["bits"], head["sizes"], part["ranks"], part["rest"], part["prints"], part["slots"])

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the document with this key (the first, where it repeats); None: there is none."""
        at = int(self.index.find(np.array([key]))[0])
        if at < 0 or self.null_keys:
            return None
        i = int(self.first[at])
        return self.payload[self.starts[i] : self.starts[i + 1]]


class TokenFileReader:
    """A file of ids, read by ranges: the header and the index when it is opened, and for each key its place and its ids alone."""

    def __init__(self, path: str):
        head = get_range(path, 0, 12)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        n = int(np.frombuffer(head, "<u4", 1, 8)[0])
        spec = json.loads(get_range(path, 12, n))
        self.path, self.base, self.sections, self.null_keys = path, 12 + n, spec["sections"], spec["null_keys"]
        part = {k: self._read(k, 0, None) for k in ("bits", "ranks", "rest", "prints", "slots")}
        self.index = KeyIndex(part["bits"], spec["sizes"], part["ranks"], part["rest"], part["prints"], part["slots"])

    def _read(self, section: str, first: int, count: int | None) -> np.ndarray:
        x = self.sections[section]
        kind = np.dtype(x["dtype"])
        n = x["bytes"] if count is None else count * kind.itemsize
        return np.frombuffer(get_range(self.path, self.base + x["at"] + first * kind.itemsize, n) if n else b"", kind)

    def get(self, key: int) -> np.ndarray | None:
        """Ids of the document with this key (the first, where it repeats); None: there is none."""
        at = int(self.index.find(np.array([key]))[0])
        if at < 0 or self.null_keys:
            return None
        place = int(self._read("first", at, 1)[0])
        begin, end = self._read("starts", place, 2).tolist()
        return self._read("payload", begin, end - begin)


def write_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Write every document's ids in ascending key order; return the folder and its manifest.

    The manifest has a row per file, in order: path, first_key, last_key, documents, tokens, start (the ids of all files
    before it). Documents with a null key have no place in the order: they come first, in files of their own. Repeated keys are kept
    side by side. An empty table makes an empty manifest. A task that is run again writes files of other names; the
    manifest names those of the attempt that Spark kept.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, size = docs.select(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    parts = max(1, min(rows, -(-int(size) // (6 * file_tokens)), 100_000)) if rows else 1
    parts = max(parts, min(rows, spark.sparkContext.defaultParallelism * 4)) if rows else 1
    bounds = range_bounds(docs, key, parts)
    ids = encode(docs, tokenizer, end_id, key, text).select(bucket("key", bounds).alias("shard"), "key", "ids", "n_tokens")
    folder = new_path(spark, "tokens")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        dtype, shard, keys, raw, held, made = None, None, [], [], 0, []

        def close() -> None:
            nonlocal keys, raw, held
            if keys:
                path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.tok"
                named = np.array([k or 0 for k in keys], np.int64)
                put_bytes(path, file_bytes(named, np.array([len(x) // dtype.itemsize for x in raw]), b"".join(raw), dtype, keys[0] is None))
                made.append((path, shard, len(made), keys[0], keys[-1], len(keys), held))
            keys, raw, held = [], [], 0

        for b in batches:
            dtype = dtype or encoder(tokenizer).dtype
            for s, k, x, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard or held and held + n > file_tokens or keys and (keys[-1] is None) != (k is None):
                    close()
                    shard = s
                keys.append(k)
                raw.append(x)
                held += n
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), *[pa.int64()] * 6), strict=True)], ["path", "shard", "seq", "first_key", "last_key", "documents", "tokens"])

    # Each shard holds about as many rows; with the sort, a writer streams and holds one file at most.
    sent = ids.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "key")
    files = materialize(sent.mapInArrow(run, "path string, shard bigint, seq bigint, first_key bigint, last_key bigint, documents bigint, tokens bigint"), "manifest")
    # Files of a shard count up within its task; shards are the runs of the prefix sum.
    numbered = files.select("path", "first_key", "last_key", "documents", "tokens", F.lit(0).alias("one"), (F.col("shard") * F.lit(1 << 24) + F.col("seq")).alias("place"))
    return folder, materialize(running(numbered, "one", "place", F.col("tokens"), "start", 1 << 24).drop("one", "place"), "files")


def read_files(manifest: DataFrame) -> DataFrame:
    """A row per document of the files: doc_id, start, n_tokens, ids_crc32; each is found by its key through the index.

    ids_crc32: crc32 of the ids as little-endian unsigned 32-bit integers. Of repeated keys, the others follow the first.
    """
    spark = manifest.sparkSession
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(get_bytes(path))
                at = f.first[f.index.find(f.keys)].astype(np.int64)
                if len(f.first) < len(f.keys):  # repeated keys: the others follow the first
                    at += np.arange(len(f.keys)) - np.maximum.accumulate(np.where(np.concatenate([[True], f.keys[1:] != f.keys[:-1]]), np.arange(len(f.keys)), 0))
                starts, ends = f.starts[at], f.starts[at + 1]
                crc = [zlib.crc32(f.payload[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                names = pa.nulls(len(f.keys), pa.int64()) if f.null_keys else pa.array(f.keys)
                yield pa.RecordBatch.from_arrays([names, pa.array(starts + before), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), 1 << 16))
    return manifest.select("path", "start").repartition(n).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def look_up(manifest: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit) of each distinct key that the files hold; of a repeated key, its first document.

    Keys are dealt to files by the files' last keys (a long per file, on the driver); a task opens a file once and reads the ranges of its keys.
    """
    spark = manifest.sparkSession
    ship(spark)
    files = [(r.path, r.last_key) for r in manifest.where("last_key is not null").orderBy("start").select("path", "last_key").collect()]
    numbers = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(files)], "file int, path string")
    # A key is in the first file whose last key isn't below it, or in none.
    asked = keys.select(F.col(key).cast("bigint").alias("key")).where("key is not null").distinct().withColumn("file", bucket("key", [k for _, k in files]))
    sent = asked.join(numbers, "file").select("path", "key").repartition("path").sortWithinPartitions("path", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            rows = []
            for path, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is None or now.path != path:
                    now = TokenFileReader(path)
                if (ids := now.get(k)) is not None:
                    rows.append((k, len(ids), ids.astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "n_tokens", "ids"])

    return sent.mapInArrow(run, "key bigint, n_tokens bigint, ids binary")
