"""Chunked stores: every codec and layout against arrays made by hand, and what isn't known."""

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from spectramesh.sources import stores


def frame(data: bytes, width: int, codec: str, shuffle: str, block: int, split: bool) -> bytes:
    """A Blosc frame, encoded plainly."""
    flags = {"lz4_raw": 1, "snappy": 2, "zlib": 3, "zstd": 4}[codec] << 5 | {"byte": 1, "bit": 4, "none": 0}[shuffle] | (0 if split else 16)
    body, starts = b"", []
    count = -(-len(data) // block)
    for k in range(count):
        part = data[k * block : (k + 1) * block]
        n = len(part) // width // (8 if shuffle == "bit" else 1) * (8 if shuffle == "bit" else 1)
        x = np.frombuffer(part[: n * width], np.uint8)
        if shuffle == "byte":
            x = x.reshape(n, width).T.ravel()
        elif shuffle == "bit":
            x = np.packbits(np.unpackbits(x, bitorder="little").reshape(n, width * 8).T.ravel(), bitorder="little")
        part = x.tobytes() + part[n * width :]
        streams = width if split and len(part) == block and width <= 16 and block // width >= 128 else 1
        starts.append(16 + 4 * count + len(body))
        for s in range(streams):
            one = part[s * len(part) // streams : (s + 1) * len(part) // streams]
            packed = zlib.compress(one) if codec == "zlib" else pa.compress(one, codec=codec, asbytes=True)
            packed = one if len(packed) >= len(one) else packed
            body += struct.pack("<i", len(packed)) + packed
    head = struct.pack("<4B3I", 2, 1, flags, width, len(data), block, 16 + 4 * count + len(body))
    return head + struct.pack(f"<{count}I", *starts) + body


@pytest.mark.parametrize("codec", ["lz4_raw", "snappy", "zlib", "zstd"])
@pytest.mark.parametrize("shuffle", ["none", "byte", "bit"])
@pytest.mark.parametrize("width, n, block, split", [(8, 1000, 4096, True), (8, 1000, 4096, False), (4, 333, 512, True), (1, 700, 256, True), (8, 3, 4096, True), (3, 500, 600, True)])
def test_blosc(codec, shuffle, width, n, block, split):
    data = (np.arange(n * width) // 7 % 251).astype(np.uint8).tobytes()
    assert stores.blosc(frame(data, width, codec, shuffle, block, split)) == data
    assert stores.blosc(struct.pack("<4B3I", 2, 1, 2, width, len(data), block, 16 + len(data)) + data) == data


def put(path, name, data):
    at = path / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_bytes(data if isinstance(data, bytes) else json.dumps(data).encode())


def array(path, name, x, chunks, pack, compressor, separator=".", order="C", skip=(), fill=0.0, **more):
    text = x.dtype == object
    put(path, f"{name}/.zarray", {"zarr_format": 2, "shape": list(x.shape), "chunks": list(chunks), "dtype": "|O" if text else x.dtype.str, "compressor": compressor, "fill_value": fill, "order": order, "filters": [{"id": "vlen-utf8"}] if text else None, "dimension_separator": separator} | more)
    for spot in np.ndindex(*(-(-s // c) for s, c in zip(x.shape, chunks))):
        if spot in skip:
            continue
        part = np.full(chunks, "" if text else 0, x.dtype)
        some = x[tuple(slice(i * c, (i + 1) * c) for i, c in zip(spot, chunks))]
        part[tuple(slice(0, n) for n in some.shape)] = some
        raw = struct.pack("<I", part.size) + b"".join(struct.pack("<I", len(s.encode())) + s.encode() for s in part.ravel()) if text else part.tobytes(order=order)
        put(path, f"{name}/{separator.join(map(str, spot))}", pack(raw))


PACKS = {
    "plain": (lambda b: b, None, ".", "C"),
    "zlib": (zlib.compress, {"id": "zlib"}, "/", "C"),
    "zstd": (lambda b: zstandard.compress(b), {"id": "zstd"}, ".", "F"),
    "lz4": (lambda b: struct.pack("<I", len(b)) + pa.compress(b, codec="lz4_raw", asbytes=True), {"id": "lz4"}, ".", "C"),
    "blosc": (lambda b: frame(b, 8, "lz4_raw", "byte", 512, True), {"id": "blosc", "cname": "lz4"}, "/", "F"),
}


@pytest.mark.parametrize("pack", sorted(PACKS))
def test_read_table(spark, tmp_path, pack):
    f, codec, sep, order = PACKS[pack]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25, 7))
    x[4, 2] = np.nan
    array(tmp_path, "X", x, (10, 3), f, codec, sep, order, skip=((1, 1),), fill="NaN")
    names = np.array([f"v{i}" for i in range(7)], object)
    put(tmp_path, "var/.zattrs", {"_index": "gene"})
    array(tmp_path, "var/gene", names, (4,), f, codec)
    put(tmp_path, "obs/.zattrs", {"_index": "cell", "column-order": ["label", "kind", "note", "size"]})
    cells = np.array([f"é{i}" for i in range(25)], object)
    array(tmp_path, "obs/cell", cells, (9,), f, codec)
    array(tmp_path, "obs/label", np.arange(25) * 10**15, (8,), f, codec, skip=((2,),), fill=-5)
    put(tmp_path, "obs/kind/.zattrs", {"encoding-type": "categorical"})
    array(tmp_path, "obs/kind/codes", (np.arange(25) % 3 - 1).astype("i1"), (25,), lambda b: b, None)
    array(tmp_path, "obs/kind/categories", np.array(["a", "b"], object), (2,), f, codec)
    array(tmp_path, "obs/note", np.array([f"n{i % 4}" for i in range(25)], "S4"), (6,), lambda b: b, None, fill="")
    array(tmp_path, "obs/size", x[:, 0].astype("f4"), (25,), lambda b: b, None)
    assert stores.columns_of(spark, str(tmp_path)) == (list(names), ["label", "kind", "note", "size"])
    got = stores.read_table(spark, str(tmp_path)).orderBy("row").collect()
    want = x.copy()
    want[10:20, 3:6] = np.nan
    assert np.array_equal(np.array([[r[f"v{i}"] for i in range(7)] for r in got]), want, equal_nan=True)
    assert [r.obs_name for r in got] == list(cells) and [r.row for r in got] == list(range(25))
    assert [r.label for r in got] == [i * 10**15 if not 16 <= i < 24 else -5 for i in range(25)]
    assert [r.kind for r in got] == [[None, "a", "b"][i % 3] for i in range(25)]
    assert [r.note for r in got] == [f"n{i % 4}" for i in range(25)] and np.allclose([r.size for r in got], x[:, 0], atol=1e-6)
    some = stores.read_table(spark, str(tmp_path), ["v6", "v0"], ["kind"])
    assert some.columns == ["row", "obs_name", "kind", "v6", "v0"]
    assert {r.row: (r.v6, r.v0) for r in some.collect()} == {i: (x[i, 6], x[i, 0]) for i in range(25)}
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") >= 1 and len(some.inputFiles()) < len(stores.read_table(spark, str(tmp_path)).inputFiles())


def test_round_trip_and_refusals(spark, tmp_path):
    rows = spark.range(130).select(F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("name"), (F.col("id") * 3).alias("n"), F.when(F.col("id") != 7, F.col("id") / 4).alias("w"), F.col("id").cast("string").alias("t"), *(F.when(F.col("id") != 9, F.col("id") + k * 0.5).alias(f"x{k}") for k in range(5))).repartition(7)
    at = str(tmp_path / "made")
    assert stores.write_table(rows, at, "name", [f"x{k}" for k in range(5)], ["n", "w", "t"], row_chunk=32, column_chunk=2) == 130
    got = stores.read_table(spark, at).orderBy("row").collect()
    assert [(r.obs_name, r.n, r.t, r.x4) for r in got if r.row not in (7, 9)] == [(f"i{i:04}", 3 * i, str(i), i + 2.0) for i in range(130) if i not in (7, 9)]
    assert np.isnan(got[9].x1) and np.isnan(got[7].w)
    none = str(tmp_path / "none")
    assert stores.write_table(rows.limit(0), none, "name", ["x0"], ["n"]) == 0
    assert stores.read_table(spark, none).collect() == []
    with pytest.raises(ValueError, match="no columns"):
        stores.read_table(spark, at, ["nothing"])
    put(tmp_path, "made/X/.zarray", {"shape": [1], "chunks": [1], "dtype": "<f8", "compressor": {"id": "lzma"}})
    with pytest.raises(ValueError, match="lzma"):
        stores.read_table(spark, at)
    put(tmp_path, "sparse/X/.zattrs", {"encoding-type": "csr_matrix"})
    put(tmp_path, "sparse/var/.zattrs", {"_index": "i"})
    array(tmp_path, "sparse/var/i", np.array(["a"], object), (1,), zlib.compress, {"id": "zlib"})
    with pytest.raises(ValueError, match="csr_matrix"):
        stores.read_table(spark, str(tmp_path / "sparse"))
