"""Mesh files as tables. Files are read by Spark's own binary reader, so any store that it reaches will do."""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectramesh.schemas import MESH_FILES

Mesh = tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]


def parse(path: str, data: bytes) -> Mesh:
    """(vertices, triangles, fields by name) by the file's suffix: .stl, .obj or .vtp."""
    kind = path.lower().rpartition(".")[2]
    if kind not in PARSERS:
        raise ValueError(f"unsupported mesh file {path!r}: .stl, .obj, .vtp")
    return PARSERS[kind](data)


def parse_stl(data: bytes) -> Mesh:
    """Binary or text; corners at equal positions become one vertex, numbered by first appearance."""
    n = struct.unpack_from("<I", data, 80)[0] if len(data) >= 84 else -1
    if n >= 0 and len(data) == 84 + 50 * n:
        raw = np.frombuffer(data, np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("more", "<u2")]), n, 84)
        corners = raw["corner"].reshape(-1, 3).astype(float)
    else:
        found = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data)
        if not found or len(found) % 3:
            raise ValueError("not an STL file")
        corners = np.array([[float(x) for x in row] for row in found])
    _, first, back = np.unique(corners, axis=0, return_index=True, return_inverse=True)
    place = np.empty(len(first), int)
    place[np.argsort(first, kind="stable")] = np.arange(len(first))
    return corners[np.sort(first)], place[back.ravel()].reshape(-1, 3), {}


def parse_obj(data: bytes) -> Mesh:
    """Lines v and f; polygons become fans, negative numbers count from the end."""
    v, f = [], []
    for line in data.decode("utf-8", "replace").splitlines():
        word, *rest = line.split() or [""]
        if word == "v":
            v.append([float(x) for x in rest[:3]])
        elif word == "f":
            ids = [int(x.split("/")[0]) for x in rest]
            ids = [i - 1 if i > 0 else len(v) + i for i in ids]
            f += [[ids[0], a, b] for a, b in zip(ids[1:], ids[2:])]
    return np.array(v, float).reshape(-1, 3), np.array(f, int).reshape(-1, 3), {}


#: Names of number types in the XML format.
_TYPES = {"Float32": "f4", "Float64": "f8", "Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8"}


def parse_vtp(data: bytes) -> Mesh:
    """Polygonal data in XML: text, base64 or raw appended arrays, plain or zlib-compressed; polygons become fans."""
    raw = b""
    if (at := data.find(b"<AppendedData")) >= 0:
        begin, end = data.index(b"_", data.index(b">", at)) + 1, data.rindex(b"</AppendedData>")
        raw, packed = data[begin:end], b"base64" in data[at : data.index(b">", at)]
        data = data[:at] + b"</VTKFile>"
    else:
        packed = False
    root = ElementTree.fromstring(data)
    order = "<" if root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
    head, zipped = order + ("u8" if root.get("header_type") == "UInt64" else "u4"), root.get("compressor") is not None

    def blob(b: bytes, is_base64: bool) -> bytes:
        width = np.dtype(head).itemsize

        def take(n: int, skip: int = 0) -> bytes:  # n bytes of one encoded block that begins at `skip` characters
            return base64.b64decode(b[skip : skip + -(-n // 3) * 4])[:n]

        if not zipped:
            n = int(np.frombuffer((take(width) if is_base64 else b[:width]), head)[0])
            return take(width + n)[width:] if is_base64 else b[width : width + n]
        n = int(np.frombuffer(take(width) if is_base64 else b[:width], head)[0])
        sizes = np.frombuffer(take(width * (3 + n)) if is_base64 else b[: width * (3 + n)], head)[3:].astype(int)
        body = base64.b64decode(b[-(-width * (3 + n) // 3) * 4 :][: -(-int(sizes.sum()) // 3) * 4]) if is_base64 else b[width * (3 + n) :]
        out, at = [], 0
        for s in sizes:
            out.append(zlib.decompress(body[at : at + s]))
            at += s
        return b"".join(out)

    def array(node: ElementTree.Element) -> np.ndarray:
        kind = order + _TYPES[node.get("type")]
        how = node.get("format", "ascii")
        if how == "ascii":
            x = np.array((node.text or "").split(), dtype=np.dtype(kind))
        elif how == "binary":
            x = np.frombuffer(blob("".join((node.text or "").split()).encode(), True), kind)
        else:
            x = np.frombuffer(blob(raw[int(node.get("offset", 0)) :], packed), kind)
        n = int(node.get("NumberOfComponents", "1"))
        return x.reshape(-1, n) if n > 1 else x

    v, f, fields, base = [], [], {}, 0
    for piece in root.iter("Piece"):
        points = array(piece.find("Points/DataArray")).astype(float).reshape(-1, 3)
        polys = {d.get("Name"): array(d) for d in piece.findall("Polys/DataArray")}
        ids, ends = polys["connectivity"].astype(int) + base, polys["offsets"].astype(int)
        for a, b in zip(np.concatenate([[0], ends[:-1]]), ends):
            f += [[ids[a], ids[k], ids[k + 1]] for k in range(a + 1, b - 1)]
        for d in piece.findall("PointData/DataArray"):
            x = array(d)
            for c in range(x.shape[1] if x.ndim > 1 else 1):
                name = d.get("Name") + (f"_{c}" if x.ndim > 1 else "")
                fields.setdefault(name, []).append((x[:, c] if x.ndim > 1 else x).astype(float))
        v.append(points)
        base += len(points)
    return np.concatenate(v) if v else np.zeros((0, 3)), np.array(f, int).reshape(-1, 3), {k: np.concatenate(x) for k, x in fields.items()}


PARSERS = {"stl": parse_stl, "obj": parse_obj, "vtp": parse_vtp}


def read_meshes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: mesh_id (the file's name without suffix), path, vertices, faces, fields, status (ok, error), error.

    A file that can't be read gives a row with its error instead of failing the job.
    """

    def triples(x: np.ndarray, names: str, kind: pa.DataType) -> pa.Array:
        """One list of structs, from the columns of an array."""
        parts = [pa.array(np.ascontiguousarray(x[:, k]), kind) for k in range(3)]
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.StructArray.from_arrays(parts, list(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.list_(pa.struct([(c, t) for c in names])) for names, t in (("xyz", pa.float64()), ("abc", pa.int32()))] + [pa.list_(pa.struct([("field", pa.string()), ("values", pa.list_(pa.float64()))]))]
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, status, error = at.rstrip("/").rpartition("/")[2].rpartition(".")[0], "ok", None
                try:
                    v, f, fields = parse(at, data)
                    cols = [triples(np.asarray(v, float).reshape(-1, 3), "xyz", pa.float64()), triples(np.asarray(f, np.int32).reshape(-1, 3), "abc", pa.int32()), pa.array([[{"field": k, "values": np.asarray(x, float)} for k, x in fields.items()]], kinds[2])]
                except Exception as e:  # any damage of a file is its row's error
                    cols, status, error = [pa.nulls(1, t) for t in kinds], "error", f"{type(e).__name__}: {e}"
                one = [pa.array([name]), pa.array([at]), *cols, pa.array([status]), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(one, ["mesh_id", "path", "vertices", "faces", "fields", "status", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MESH_FILES)


def vertices(meshes: DataFrame) -> DataFrame:
    return meshes.where("status = 'ok'").select("mesh_id", F.posexplode("vertices").alias("vid", "_v")).select("mesh_id", "vid", "_v.x", "_v.y", "_v.z")


def faces(meshes: DataFrame) -> DataFrame:
    return meshes.where("status = 'ok'").select("mesh_id", F.posexplode("faces").alias("fid", "_f")).select("mesh_id", "fid", "_f.a", "_f.b", "_f.c")


def vertex_fields(meshes: DataFrame) -> DataFrame:
    one = meshes.where("status = 'ok'").select("mesh_id", F.explode("fields").alias("_f"))
    return one.select("mesh_id", F.col("_f.field").alias("field"), F.posexplode("_f.values").alias("vid", "value")).select("mesh_id", "vid", "field", "value")


def from_arrays(spark: SparkSession, mesh_id: str, v: np.ndarray, f: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of one mesh, as they are."""
    vs = spark.createDataFrame([(mesh_id, i, *map(float, r)) for i, r in enumerate(v)], "mesh_id string, vid int, x double, y double, z double")
    return vs, spark.createDataFrame([(mesh_id, i, *map(int, r)) for i, r in enumerate(f)], "mesh_id string, fid int, a int, b int, c int")


def obj_text(v: np.ndarray, f: np.ndarray) -> str:
    return "".join(f"v {x!r} {y!r} {z!r}\n" for x, y, z in v.tolist()) + "".join(f"f {a + 1} {b + 1} {c + 1}\n" for a, b, c in f.tolist())


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """One text file per mesh, under `path`/mesh_id=..., in the .obj form."""
    lines = vertices.select("mesh_id", F.lit(0).alias("k"), F.col("vid").alias("n"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value")).unionByName(
        faces.select("mesh_id", F.lit(1).alias("k"), F.col("fid").alias("n"), F.concat_ws(" ", F.lit("f"), F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    )
    lines.repartition("mesh_id").sortWithinPartitions("mesh_id", "k", "n").select("mesh_id", "value").write.mode("overwrite").partitionBy("mesh_id").text(path)


def stl_bytes(v: np.ndarray, f: np.ndarray) -> bytes:
    """Binary STL: 32-bit corners, normals left at zero."""
    out = np.zeros(len(f), np.dtype([("normal", "<f4", 3), ("corner", "<f4", (3, 3)), ("more", "<u2")]))
    out["corner"] = v[f]
    return bytes(80) + struct.pack("<I", len(f)) + out.tobytes()


def vtp_text(v: np.ndarray, f: np.ndarray, fields: dict[str, np.ndarray]) -> str:
    """Polygonal data in XML, arrays as text."""

    def array(kind: str, values: np.ndarray, more: str = "") -> str:
        return f'<DataArray type="{kind}" format="ascii"{more}>{" ".join(map(repr, values.ravel().tolist()))}</DataArray>'

    data = "".join(array("Float64", x, f' Name="{k}"') for k, x in fields.items())
    polys = array("Int64", f, ' Name="connectivity"') + array("Int64", np.arange(1, len(f) + 1) * 3, ' Name="offsets"')
    points = array("Float64", v, ' NumberOfComponents="3"')
    return f'<VTKFile type="PolyData" byte_order="LittleEndian"><PolyData><Piece NumberOfPoints="{len(v)}" NumberOfPolys="{len(f)}"><PointData>{data}</PointData><Points>{points}</Points><Polys>{polys}</Polys></Piece></PolyData></VTKFile>'


def write_files(vertices: DataFrame, faces: DataFrame, path: str, kind: str = "obj", fields: DataFrame | None = None) -> DataFrame:
    """Write one file per mesh, path/<mesh_id>.<kind> (stl, obj, vtp); fields (mesh_id, vid, field, value) go into .vtp alone. Returns mesh_id, path, bytes.

    A file appears as a whole; a task that is run again replaces it by an equal one.
    """
    if kind not in PARSERS:
        raise ValueError(f"unsupported kind {kind!r}: stl, obj, vtp")
    points = vertices.select("mesh_id", "vid", "x", "y", "z")
    if fields is not None:
        named = fields.groupBy(F.col("mesh_id").alias("_m"), F.col("vid").alias("_v")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
        points = points.join(named, (F.col("mesh_id") == F.col("_m")) & (F.col("vid") == F.col("_v")), "left").drop("_m", "_v")

    def run(key: tuple, v: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        v, f = v.sort_values("vid"), f.sort_values("fid")
        at, tri = v[["x", "y", "z"]].to_numpy(float), np.searchsorted(v["vid"].to_numpy(), f[["a", "b", "c"]].to_numpy())
        rows = [dict(x) if x is not None else {} for x in v["fields"]] if "fields" in v else []
        found = {k: np.array([x.get(k, np.nan) for x in rows]) for k in sorted({k for x in rows for k in x})}
        data = stl_bytes(at, tri) if kind == "stl" else (obj_text(at, tri) if kind == "obj" else vtp_text(at, tri, found)).encode()
        to = f"{path}/{key[0]}.{kind}"
        put(to, data)
        return pd.DataFrame({"mesh_id": [key[0]], "path": [to], "bytes": [len(data)]})

    # Names of their own: vertices, faces and fields may come from one table.
    points, corners = points.withColumnRenamed("mesh_id", "_mesh"), faces.select(F.col("mesh_id").alias("_other"), "fid", "a", "b", "c")
    return points.groupBy("_mesh").cogroup(corners.groupBy("_other")).applyInPandas(run, "mesh_id string, path string, bytes bigint")


def put(path: str, data: bytes) -> None:
    """A file of any store that pyarrow reaches; local ones are moved into place when they are whole."""
    if path.startswith("file:") or "://" not in path:
        at = Path("/" + path[5:].lstrip("/") if path.startswith("file:") else path)
        at.parent.mkdir(parents=True, exist_ok=True)
        part = at.with_name(f".{at.name}.{uuid.uuid4().hex}")
        part.write_bytes(data)
        part.replace(at)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_output_stream(at) as out:
        out.write(data)
