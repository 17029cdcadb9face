"""Tables in chunked array stores: annotated matrices of the Zarr format, version 2, read and written chunk by chunk.

A store is a folder: `X`, a matrix with a row per item, in chunks of rows and columns; `var`, the names of its columns; `obs`, a folder with an
array per further column and the items' names. Only the small JSON documents about shapes and types are read on the driver. Chunks are files
that Spark lists and deals out - each is one record of the `binaryFile` source, so no task holds more than its chunks - and only those
are listed that hold wanted columns. Decoded pieces of a row meet in one shuffle by row number. Chunks that are missing count as fill values.

Decoded here: zlib, gzip, zstd and lz4 streams, Blosc frames of those with byte or bit shuffling, fixed-width numbers and strings, variable-length
strings, categories, both dimension separators and both memory orders. Sparse matrices and the codec blosclz raise ValueError.
"""

from __future__ import annotations

import base64
import json
import math
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectramesh.sources.meshes import put
from spectramesh.sources.tables import written

#: Fixed values of the Blosc frame: bits of its flags, and the codes of its compressors.
SHUFFLE, PLAIN, BITS, WHOLE = 1, 2, 4, 16
BLOSC_CODECS = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}
ROW_CHUNK = 4096


# ---- chunks ---------------------------------------------------------------------------------------------------------


def _expand(data: bytes, codec: str, size: int) -> bytes:
    if codec in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    return pa.decompress(data, decompressed_size=size, codec=codec, asbytes=True)


def _unshuffle(block: bytes, width: int, bits: bool) -> bytes:
    """Blosc stores the first bytes (or bits) of all elements, then the second ones, and so on; what is over stays as it is."""
    n = len(block) // width
    if bits:
        n -= n % 8
    body, rest = block[: n * width], block[n * width :]
    x = np.frombuffer(body, np.uint8)
    if bits:
        x = np.packbits(np.unpackbits(x, bitorder="little").reshape(width * 8, n).T.ravel(), bitorder="little")
    else:
        x = x.reshape(width, n).T.ravel()
    return x.tobytes() + rest


def blosc(data: bytes) -> bytes:
    """The content of a Blosc frame: a header, the places of its blocks, and in each block one or `width` streams."""
    _, _, flags, width, size, block, _ = struct.unpack("<4B3I", data[:16])
    if flags & PLAIN:
        return data[16 : 16 + size]
    if (code := flags >> 5) not in BLOSC_CODECS:
        raise ValueError(f"Blosc codec {code} isn't known")
    out = []
    for k, at in enumerate(struct.unpack(f"<{-(-size // block)}I", data[16 : 16 + 4 * -(-size // block)])):
        here = min(block, size - k * block)
        streams = width if not flags & WHOLE and here == block and 1 < width <= 16 and block // width >= 128 else 1
        got = b""
        for _ in range(streams):
            (n,) = struct.unpack("<i", data[at : at + 4])
            part = data[at + 4 : at + 4 + n]
            got += part if n == here // streams else _expand(part, BLOSC_CODECS[code], here // streams)
            at += 4 + n
        out.append(_unshuffle(got, width, bool(flags & BITS)) if flags & (SHUFFLE | BITS) and width > 1 - bool(flags & BITS) else got)
    return b"".join(out)


@dataclass(frozen=True)
class Layout:
    """What a store says of one array."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    compressor: str | None
    strings: bool
    fill: object
    order: str
    separator: str

    @classmethod
    def of(cls, meta: dict) -> Layout:
        codec = (meta.get("compressor") or {}).get("id")
        if codec not in (None, "zlib", "gzip", "zstd", "lz4", "blosc"):
            raise ValueError(f"compressor {codec!r} isn't known")
        filters = [f["id"] for f in meta.get("filters") or []]
        if filters not in ([], ["vlen-utf8"]):
            raise ValueError(f"filters {filters} aren't known")
        fill = meta.get("fill_value")
        if isinstance(fill, str) and np.dtype(meta["dtype"]).kind == "S":
            fill = base64.b64decode(fill).decode()
        elif fill in ("NaN", "Infinity", "-Infinity"):
            fill = float(fill.replace("Infinity", "inf"))
        if (filters or np.dtype(meta["dtype"]).kind in "SUO") and not isinstance(fill, str):
            fill = ""
        return cls(tuple(meta["shape"]), tuple(meta["chunks"]), meta["dtype"], codec, filters == ["vlen-utf8"], fill, meta.get("order", "C"), meta.get("dimension_separator", "."))

    @property
    def kind(self) -> str:
        """real, whole or text."""
        return "text" if self.strings else {"f": "real", "i": "whole", "u": "whole", "b": "whole"}.get(np.dtype(self.dtype).kind, "text")

    def decode(self, data: bytes) -> np.ndarray:
        """A whole chunk; strings as objects."""
        n = math.prod(self.chunks)
        if self.compressor == "blosc":
            data = blosc(data)
        elif self.compressor == "lz4":  # the size, then one block
            data = _expand(data[4:], "lz4_raw", struct.unpack("<I", data[:4])[0])
        elif self.compressor == "zstd":
            from zstandard import ZstdDecompressor

            data = ZstdDecompressor().decompressobj().decompress(data)
        elif self.compressor:
            data = _expand(data, self.compressor, 0)
        if self.strings:
            (count,), at, out = struct.unpack("<I", data[:4]), 4, []
            for _ in range(count):
                (size,) = struct.unpack("<I", data[at : at + 4])
                out.append(data[at + 4 : at + 4 + size].decode())
                at += 4 + size
            return np.array(out, object).reshape(self.chunks)
        x = np.frombuffer(data, np.dtype(self.dtype), n).reshape(self.chunks, order=self.order)
        return np.char.decode(x, "utf-8").astype(object) if x.dtype.kind == "S" else x.astype(object) if x.dtype.kind == "U" else x

    def filled(self) -> np.ndarray:
        return np.full(self.shape, "" if self.kind == "text" and self.fill is None else 0 if self.fill is None else self.fill, object if self.kind == "text" else np.dtype(self.dtype))


# ---- what the driver reads ------------------------------------------------------------------------------------------


def _fetch(spark: SparkSession, path: str) -> bytes | None:
    """A small file of any store that Spark reaches; None where there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(at):
        return None
    stream = store.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _meta(spark: SparkSession, path: str, name: str) -> dict | None:
    found = _fetch(spark, f"{path}/{name}")
    return None if found is None else json.loads(found)


def _array(spark: SparkSession, path: str) -> Layout:
    meta = _meta(spark, path, ".zarray")
    if meta is None:
        kind = (_meta(spark, path, ".zattrs") or {}).get("encoding-type")
        raise ValueError(f"{path} is no array" + f" but a {kind}" * bool(kind))
    return Layout.of(meta)


def _small_array(spark: SparkSession, path: str) -> np.ndarray:
    """A one-dimensional array as a whole: the names of columns, or of categories."""
    at = _array(spark, path)
    out = at.filled()
    for k in range(-(-at.shape[0] // at.chunks[0])):
        data = _fetch(spark, f"{path}/{k}")
        if data is not None:
            out[k * at.chunks[0] : (k + 1) * at.chunks[0]] = at.decode(data)[: at.shape[0] - k * at.chunks[0]]
    return out


# ---- reading --------------------------------------------------------------------------------------------------------

_PIECES = "row bigint, part int, reals array<double>, whole bigint, text string"


def columns_of(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(names of the matrix's columns, names of the further columns)."""
    var = _meta(spark, f"{path}/var", ".zattrs") or {}
    obs = _meta(spark, f"{path}/obs", ".zattrs") or {}
    return [str(x) for x in _small_array(spark, f"{path}/var/{var.get('_index', '_index')}")], list(obs.get("column-order", []))


def read_table(spark: SparkSession, path: str, var: list[str] | None = None, obs: list[str] | None = None) -> DataFrame:
    """row (from 0), obs_name, the wanted further columns, the wanted columns of the matrix (all, if not told) of one store.

    Numbers come as double or bigint, everything else as string; a category that is missing is null. A NaN stays a NaN. A name that
    occurs twice among the wanted columns raises ValueError.
    """
    path = path.rstrip("/")
    names, further = columns_of(spark, path)
    var, obs = names if var is None else var, further if obs is None else obs
    if unknown := [c for c in var if c not in names] + [c for c in obs if c not in further]:
        raise ValueError(f"{path} has no columns {unknown}")
    wanted = ["row", "obs_name", *obs, *var]
    if len({c.lower() for c in wanted}) < len(wanted):
        raise ValueError(f"columns of {path} share a name: {wanted}")
    matrix, index = _array(spark, f"{path}/X"), (_meta(spark, f"{path}/obs", ".zattrs") or {}).get("_index", "_index")
    if len(matrix.shape) != 2 or matrix.shape[1] != len(names):
        raise ValueError(f"{path}/X has the shape {matrix.shape} and {len(names)} names")
    rows = matrix.shape[0]
    place = {c: names.index(c) for c in var}
    width = matrix.chunks[1]
    # Array, folder of the array, categories: the matrix first, then one entry per further column.
    parts: list[tuple[Layout, str, list[str] | None]] = [(matrix, f"{path}/X", None)]
    for c in [index, *obs]:
        attrs = _meta(spark, f"{path}/obs/{c}", ".zattrs") or {}
        if attrs.get("encoding-type") == "categorical":
            parts.append((_array(spark, f"{path}/obs/{c}/codes"), f"{path}/obs/{c}/codes", [str(x) for x in _small_array(spark, f"{path}/obs/{c}/categories")]))
        else:
            parts.append((_array(spark, f"{path}/obs/{c}"), f"{path}/obs/{c}", None))
    bands = sorted({i // width for i in place.values()})
    pieces = [spark.range(rows).select(F.col("id").alias("row"), F.lit(-1).alias("part"), F.lit(None).cast("array<double>").alias("reals"), F.lit(None).cast("bigint").alias("whole"), F.lit(None).cast("string").alias("text"))]
    for k, (at, folder, categories) in enumerate(parts):
        if k or bands:
            glob = [f"{folder}/*{at.separator}{b}" for b in bands] if not k else [f"{folder}/[0-9]*"]
            pieces.append(_chunks(spark, glob, at, k, categories, len(parts)))
    all_of = pieces[0]
    for p in pieces[1:]:
        all_of = all_of.unionByName(p) if p is not None else all_of
    first = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c)))
    merged = all_of.groupBy("row").agg(
        *(first(len(parts) + b, "reals").alias(f"_x{b}") for b in bands),
        *(first(k, "text" if c or at.kind == "text" else "whole" if at.kind == "whole" else "reals").alias(f"_c{k}") for k, (at, _, c) in enumerate(parts) if k),
    )

    def fill(at: Layout, value: Column) -> Column:
        return F.coalesce(value, F.lit(("" if at.kind == "text" else 0) if at.fill is None else at.fill))

    out = [F.col("row")]
    for k, (at, _, categories) in enumerate(parts):
        if not k:
            continue
        v = F.col(f"_c{k}")
        if categories is None:
            v = fill(at, F.get(v, 0).cast("double") if at.kind == "real" else v)
        out.append(v.alias(["", "obs_name", *obs][k]))
    out += [fill(matrix, F.get(f"_x{i // width}", i % width)).cast("double").alias(c) for c, i in place.items()]
    return merged.select(*out)


def _chunks(spark: SparkSession, globs: list[str], at: Layout, part: int, categories: list[str] | None, shift: int) -> DataFrame | None:
    """Pieces of the rows of an array's chunks; None if the store holds none of them. The matrix's pieces are numbered by their band of columns."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(globs[0])
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    globs = [g for g in globs if (found := store.globStatus(jvm.org.apache.hadoop.fs.Path(g))) is not None and len(found)]
    if not globs:
        return None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                places = path.rsplit("/", len(at.shape) if at.separator == "/" else 1)[1:]
                spot = [int(x) for p in places for x in p.split(".")]
                x = at.decode(data)
                first = spot[0] * at.chunks[0]
                n = min(at.chunks[0], at.shape[0] - first)
                x, none = x[:n], pa.nulls(n)
                cols = {"reals": none.cast(pa.list_(pa.float64())), "whole": none.cast(pa.int64()), "text": none.cast(pa.string())}
                if categories is not None:
                    cols["text"] = pa.array([categories[c] if c >= 0 else None for c in x.tolist()], pa.string())
                elif at.kind == "text":
                    cols["text"] = pa.array(x.tolist(), pa.string())
                elif at.kind == "whole" and x.ndim == 1:
                    cols["whole"] = pa.array(x.astype(np.int64))
                else:
                    wide = x.reshape(n, -1).astype(float)
                    cols["reals"] = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide.shape[1], pa.int32()), pa.array(wide.ravel()))
                number = shift + spot[1] if len(spot) > 1 else part
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n)), pa.array(np.full(n, number, np.int32)), *cols.values()], ["row", "part", *cols])

    return spark.read.format("binaryFile").load(globs).select("path", "content").mapInArrow(run, _PIECES)


# ---- writing --------------------------------------------------------------------------------------------------------


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds `row`, from 0 without gaps in the given order: places within ranges, after the counts of the ranges before."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    before, bases = 0, []
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():  # a row per range
        bases.append((r["_part"], before))
        before += r["count"]
    base = df.sparkSession.createDataFrame(bases, "_part int, _base bigint")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(base), "_part").withColumn("row", F.col("_base") + F.col("_place")).drop("_part", "_base", "_place")


def write_table(df: DataFrame, path: str, name: str, var: list[str], obs: list[str] | None = None, row_chunk: int = ROW_CHUNK, column_chunk: int | None = None) -> int:
    """Write a store: `name` gives the items' names, `var` the matrix, `obs` further columns (numbers as they are, the rest as strings). The number of rows.

    Rows go by name. A group of `row_chunk` rows is one task's work, and each chunk one file; the JSON documents come last, so a store whose
    writing was broken off can't be read. The format has no nulls in plain arrays: a null string is written as an empty one, a null integer as
    zero, a null real number as NaN.
    """
    obs, path = obs or [], path.rstrip("/")
    column_chunk = min(column_chunk or 64, max(1, len(var)))
    kinds = {c: "<i8" if t in ("bigint", "int", "smallint", "tinyint") else "<f8" if t in ("double", "float") or t.startswith("decimal") else "|O" for c, t in df.dtypes if c in obs} | {name: "|O"}
    cast = {"<i8": "bigint", "<f8": "double", "|O": "string"}
    rows = numbered(df.select(F.col(f"`{name}`").cast("string").alias("_name"), *(F.col(f"`{c}`").cast(cast[kinds[c]]).alias(f"_o{i}") for i, c in enumerate(obs)), F.array(*(F.col(f"`{c}`").cast("double") for c in var)).alias("_x")), "_name")

    def strings(some: list) -> bytes:
        raw = [("" if s is None else str(s)).encode() for s in some]
        return struct.pack("<I", len(raw)) + b"".join(struct.pack("<I", len(r)) + r for r in raw)

    def padded(some: np.ndarray, fill: object) -> np.ndarray:
        return np.concatenate([some, np.full((row_chunk - len(some), *some.shape[1:]), fill, some.dtype)])

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p, at = p.sort_values("row"), int(key[0])
        x = padded(np.array([[np.nan if v is None else v for v in r] for r in p["_x"]], float).reshape(len(p), -1), np.nan)
        for b in range(-(-len(var) // column_chunk)):
            part = x[:, b * column_chunk : (b + 1) * column_chunk]
            part = np.pad(part, ((0, 0), (0, column_chunk - part.shape[1])), constant_values=np.nan)
            put(f"{path}/X/{at}.{b}", zlib.compress(np.ascontiguousarray(part, "<f8").tobytes(), 1))
        for c, column in [(name, "_name"), *((c, f"_o{i}") for i, c in enumerate(obs))]:
            v = p[column]
            if kinds[c] == "|O":
                data = strings([*v.tolist(), *[""] * (row_chunk - len(v))])
            else:
                data = padded(v.fillna(0 if kinds[c] == "<i8" else np.nan).to_numpy(kinds[c]), 0).tobytes()
            put(f"{path}/obs/{c}/{at}", zlib.compress(data, 1))
        return pd.DataFrame({"rows": [len(p)]})

    done = rows.withColumn("_chunk", F.floor(F.col("row") / row_chunk)).groupBy("_chunk").applyInPandas(run, "rows bigint").agg(F.sum("rows")).first()[0] or 0
    zipped = {"zarr_format": 2, "compressor": {"id": "zlib", "level": 1}, "order": "C"}
    text, real = {"filters": [{"id": "vlen-utf8"}], "fill_value": ""}, {"filters": None, "fill_value": "NaN"}

    def say(at: str, what: dict) -> None:
        put(f"{path}/{at}", json.dumps(what).encode())

    for c in [name, *obs]:
        say(f"obs/{c}/.zarray", zipped | (text if kinds[c] == "|O" else real if kinds[c] == "<f8" else real | {"fill_value": 0}) | {"shape": [done], "chunks": [row_chunk], "dtype": kinds[c]})
    put(f"{path}/var/_index/0", zlib.compress(strings(var), 1))
    say("var/_index/.zarray", zipped | text | {"shape": [len(var)], "chunks": [max(1, len(var))], "dtype": "|O"})
    say("var/.zattrs", {"_index": "_index", "column-order": [], "encoding-type": "dataframe"})
    say("obs/.zattrs", {"_index": name, "column-order": obs, "encoding-type": "dataframe"})
    say("X/.zarray", zipped | real | {"shape": [done, len(var)], "chunks": [row_chunk, column_chunk], "dtype": "<f8"})
    for at in ("", "obs/", "var/"):
        say(f"{at}.zgroup", {"zarr_format": 2})
    return done
