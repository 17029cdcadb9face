"""Packing by concatenate and cut (operator 9).

All documents' ids form one line, cut every `length` ids. Pass one encodes, writes ids with their task's number and the
place in that task, and sums the tokens of each task. A prefix sum over those totals (one row per task) gives each task's
offset in the line, so pass two cuts every document where the windows end without moving any row.

Only the last sequence of the line can be short. Null texts are empty documents, which still have the end id; equal rows are
packed each for itself; an empty table packs to no piece. Columns beyond key and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.llm.common import materialize, ship
from spectramesh.llm.tokens import encode, encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def line_offsets(ids: DataFrame) -> DataFrame:
    """part, base: the ids of all tasks before a task. The driver adds up one row per task that encoded documents."""
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("total")).orderBy("part").collect()
    rows, before = [], 0
    for x in totals:
        rows.append((x.part, before))
        before += x.total
    return ids.sparkSession.createDataFrame(rows, "part int, base bigint")


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds `ids`.

    start: ids of the document before the piece; offset: place in its sequence. sequence_id counts from 0 without gaps.
    """
    ship(docs.sparkSession)
    ids = materialize(encode(docs, tokenizer, end_id, key, text), "packing")
    # One row per task of pass one: a few bytes for each input split.
    placed = ids.join(F.broadcast(line_offsets(ids)), "part").select("key", F.expr("base + start_in_part").alias("at"), "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).dtype
        for b in batches:
            keys, starts = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[tuple] = []
            for k, at, raw in zip(keys, starts, b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(raw, kind).astype("<u4")
                n, begin = len(x), 0
                while begin < n:
                    sequence, offset = divmod(at + begin, length)
                    size = min(n - begin, length - offset)
                    piece = x[begin : begin + size]
                    out.append((k, begin, size, zlib.crc32(piece.tobytes()), n, sequence, offset, *([piece.astype(np.int32)] if with_ids else [])))
                    begin += size
            if out:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if name != "ids" else pa.array(c, pa.list_(pa.int32())) for name, c in zip(names, zip(*out, strict=True), strict=True)], names)

    return placed.mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame, pad_id: int, length: int = 4096) -> DataFrame:
    """The sequences themselves: sequence_id, ids (exactly `length`, padded at the end of the last one), n_tokens.

    A document's piece that fills its sequence is one already. The boundary records - pieces shorter than a sequence -
    are gathered by sequence; a sequence holds `length` of them at most.
    """
    whole = pieces.where(F.col("length") == length).select("sequence_id", "ids", F.col("length").alias("n_tokens"))
    parts = (
        pieces.where(F.col("length") < length)
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
        .select("sequence_id", F.concat(F.flatten(F.transform("p", lambda x: x["ids"])), F.array_repeat(F.lit(pad_id), (F.lit(length) - F.col("n_tokens")).cast("int"))).alias("ids"), "n_tokens")
    )
    return whole.unionByName(parts)
