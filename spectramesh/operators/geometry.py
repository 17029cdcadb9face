"""Triangle-mesh geometry as joins and sums: edges, areas, normals, the cotangent Laplacian, the mixed Voronoi mass.

vertices: mesh_id, vid, x, y, z; faces: mesh_id, fid, a, b, c.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _minus(p: Column, q: Column) -> tuple[Column, Column, Column]:
    return p["x"] - q["x"], p["y"] - q["y"], p["z"] - q["z"]


def _dot(u: tuple, v: tuple) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _cross(u: tuple, v: tuple) -> tuple[Column, Column, Column]:
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with their corners' positions pa, pb, pc (structs x, y, z), by three joins on mesh and vertex."""
    out = faces
    for c in "abc":
        p = vertices.select("mesh_id", F.col("vid").alias(c), F.struct("x", "y", "z").alias(f"p{c}"))
        out = out.join(p, ["mesh_id", c])
    return out.select("mesh_id", "fid", "a", "b", "c", "pa", "pb", "pc")


def double_area() -> Column:
    """Twice the area of a face with corners pa, pb, pc."""
    n = _cross(_minus(F.col("pb"), F.col("pa")), _minus(F.col("pc"), F.col("pa")))
    return F.sqrt(_dot(n, n))


def face_areas(vertices: DataFrame, faces: DataFrame, normalize: float | None = None) -> DataFrame:
    """mesh_id, fid, area; normalize: scale so that each mesh's areas add up to that number (4 pi: a unit sphere's)."""
    out = corners(vertices, faces).select("mesh_id", "fid", (double_area() / 2).alias("area"))
    if normalize is None:
        return out
    total = out.groupBy("mesh_id").agg(F.sum("area").alias("_t"))
    return out.join(total, "mesh_id").select("mesh_id", "fid", F.try_divide(F.col("area") * normalize, F.col("_t")).alias("area"))


def edges(faces: DataFrame) -> DataFrame:
    """mesh_id, i, j with i < j: the distinct undirected edges."""
    pairs = F.array(*(F.struct(F.least(p, q).alias("i"), F.greatest(p, q).alias("j")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select("mesh_id", F.explode(pairs).alias("e")).select("mesh_id", "e.i", "e.j").distinct()


def adjacency(faces: DataFrame) -> DataFrame:
    """mesh_id, vid, neighbours (ascending)."""
    e = edges(faces)
    both = e.select("mesh_id", F.col("i").alias("vid"), F.col("j").alias("n")).unionByName(e.select("mesh_id", F.col("j").alias("vid"), F.col("i").alias("n")))
    return both.groupBy("mesh_id", "vid").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))


def _cotangents() -> dict[str, Column]:
    """Cotangent of the angle at each corner."""
    out = {}
    for c, p, q in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
        u, v = _minus(F.col(f"p{p}"), F.col(f"p{c}")), _minus(F.col(f"p{q}"), F.col(f"p{c}"))
        n = _cross(u, v)
        out[c] = F.try_divide(_dot(u, v), F.sqrt(_dot(n, n)))
    return out


def cot_laplacian(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, i, j, w: half the sum of the cotangents opposite each edge, both ways, and the diagonal that makes rows sum to zero.

    Negative semidefinite. Faces without area add nothing.
    """
    t = corners(vertices, faces).select("mesh_id", "a", "b", "c", *(v.alias(f"_{k}") for k, v in _cotangents().items()))
    entry = F.array(
        *(F.struct(F.col(i).alias("i"), F.col(j).alias("j"), (s * F.col(f"_{k}") / 2).alias("w")) for k, p, q in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")) for i, j, s in ((p, q, 1), (q, p, 1), (p, p, -1), (q, q, -1)))
    )
    return t.select("mesh_id", F.explode(entry).alias("e")).groupBy("mesh_id", "e.i", "e.j").agg(F.sum("e.w").alias("w"))


def voronoi_mass(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id, vid, mass: mixed Voronoi areas; an obtuse face gives half its area to that corner and a quarter to the others."""
    t = corners(vertices, faces).select("mesh_id", "a", "b", "c", (double_area() / 2).alias("_s"), *(v.alias(f"_{k}") for k, v in _cotangents().items()), *(_length(p, q).alias(f"_l{k}") for k, p, q in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))))

    def share(k: str, p: str, q: str) -> Column:
        obtuse_here, obtuse = F.col(f"_{k}") < 0, (F.col("_a") < 0) | (F.col("_b") < 0) | (F.col("_c") < 0)
        inside = (F.col(f"_l{q}") * F.col(f"_{q}") + F.col(f"_l{p}") * F.col(f"_{p}")) / 8
        return F.when(obtuse_here, F.col("_s") / 2).when(obtuse, F.col("_s") / 4).otherwise(F.coalesce(inside, F.lit(0.0)))

    entry = F.array(*(F.struct(F.col(k).alias("vid"), share(k, p, q).alias("m")) for k, p, q in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b"))))
    return t.select("mesh_id", F.explode(entry).alias("e")).groupBy("mesh_id", "e.vid").agg(F.sum("e.m").alias("mass"))


def _length(p: str, q: str) -> Column:
    d = _minus(F.col(f"p{p}"), F.col(f"p{q}"))
    return _dot(d, d)


def vertex_normals(vertices: DataFrame, faces: DataFrame, weighting: str = "area") -> DataFrame:
    """mesh_id, vid, x, y, z: unit normals, faces weighted by area, or all alike (uniform). A vertex whose normals cancel out gets nulls."""
    n = _cross(_minus(F.col("pb"), F.col("pa")), _minus(F.col("pc"), F.col("pa")))
    size = F.lit(1.0) if weighting == "area" else F.sqrt(_dot(n, n))
    if weighting not in ("area", "uniform"):
        raise ValueError(f"unknown weighting {weighting!r}: area, uniform")
    t = corners(vertices, faces).select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), *(F.try_divide(v, size).alias(k) for k, v in zip("xyz", n, strict=True)))
    sums = t.groupBy("mesh_id", "vid").agg(*(F.sum(k).alias(f"_{k}") for k in "xyz"))
    length = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y") + F.col("_z") * F.col("_z"))
    return sums.select("mesh_id", "vid", *(F.try_divide(F.col(f"_{k}"), length).alias(k) for k in "xyz"))


def poles(vertices: DataFrame) -> DataFrame:
    """mesh_id, north, south: the vertices with the largest and the smallest x, the lowest number of equals."""
    return vertices.groupBy("mesh_id").agg(F.min(F.struct((-F.col("x")).alias("k"), "vid"))["vid"].alias("north"), F.min(F.struct(F.col("x").alias("k"), "vid"))["vid"].alias("south"))


def interior(vertices: DataFrame) -> DataFrame:
    """mesh_id, vid: all vertices but the poles."""
    p = poles(vertices).select("mesh_id", F.explode(F.array("north", "south")).alias("vid"))
    return vertices.select("mesh_id", "vid").join(p, ["mesh_id", "vid"], "left_anti")


def ordered_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


# ---- terms of the area-preserving parameterisation ------------------------------------------------------------------


def area_constraint(areas: DataFrame, targets: DataFrame) -> DataFrame:
    """mesh_id, fid, c: area over target, less one."""
    return areas.join(targets.select("mesh_id", "fid", F.col("area").alias("_t")), ["mesh_id", "fid"]).select("mesh_id", "fid", (F.try_divide(F.col("area"), F.col("_t")) - 1).alias("c"))


def norm_constraint(vertices: DataFrame) -> DataFrame:
    """mesh_id, vid, c: distance from the origin, less one."""
    return vertices.select("mesh_id", "vid", (F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) - 1).alias("c"))


def edge_products(vertices: DataFrame, edge: DataFrame) -> DataFrame:
    """mesh_id, objective: sum over edges of the inner product of their ends."""
    p = vertices.select("mesh_id", F.col("vid").alias("i"), *(F.col(k).alias(f"_i{k}") for k in "xyz"))
    q = vertices.select("mesh_id", F.col("vid").alias("j"), *(F.col(k).alias(f"_j{k}") for k in "xyz"))
    both = edge.join(p, ["mesh_id", "i"]).join(q, ["mesh_id", "j"])
    return both.groupBy("mesh_id").agg(F.sum(F.col("_ix") * F.col("_jx") + F.col("_iy") * F.col("_jy") + F.col("_iz") * F.col("_jz")).alias("objective"))


def augmented_lagrangian(objective: DataFrame, area_c: DataFrame, norm_c: DataFrame, mu: float) -> DataFrame:
    """mesh_id, value: objective + sum lambda c + mu / 2 sum c^2 over both constraint sets (columns c, lambda)."""
    part = lambda df: df.groupBy("mesh_id").agg(F.sum(F.col("lambda") * F.col("c") + mu / 2 * F.col("c") * F.col("c")).alias("_p"))
    both = part(area_c).unionByName(part(norm_c)).groupBy("mesh_id").agg(F.sum("_p").alias("_p"))
    return objective.join(both, "mesh_id").select("mesh_id", (F.col("objective") + F.col("_p")).alias("value"))


def constraint_maxima(area_c: DataFrame, norm_c: DataFrame) -> DataFrame:
    a, n = (df.groupBy("mesh_id").agg(F.max(F.abs("c")).alias(name)) for df, name in ((area_c, "max_area"), (norm_c, "max_norm")))
    return a.join(n, "mesh_id")


def lat_lon_grid(spark, n_lat: int, n_lon: int) -> DataFrame:
    """lat, lon in degrees: a regular grid from the north pole on, without the last latitude and longitude."""
    lat = spark.range(n_lat).select((90 - F.col("id") * (180.0 / n_lat)).alias("lat"))
    lon = spark.range(n_lon).select((F.col("id") * (360.0 / n_lon)).alias("lon"))
    return lat.crossJoin(F.broadcast(lon))


def rank_vertices(vertices: DataFrame, by: str) -> DataFrame:
    return vertices.withColumn("place", F.row_number().over(Window.partitionBy("mesh_id").orderBy(by, "vid")) - 1)
