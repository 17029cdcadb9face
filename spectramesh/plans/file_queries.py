"""Queries over sources and sinks: tables are written as files of the work folder and read back, and the SQL says what must come out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectramesh.operators import clustering, geometry, harmonics, scaling
from spectramesh.plans import pipelines
from spectramesh.plans.queries import CENTERS, DIST, GRID, MASS, TIMES, centers, grids, query, read, rounded, vectors
from spectramesh.session import new_path
from spectramesh.sources import meshes, stores, tables
from spectramesh.streaming import ingest

WHOLE = f"""WITH {GRID}, nv AS (SELECT mesh_id, count(*) AS vertices, round(sum(x), 3) + 0.0 AS sx, round(sum(y), 3) + 0.0 AS sy, round(sum(z), 3) + 0.0 AS sz FROM vert GROUP BY 1), nf AS (SELECT mesh_id, count(*) AS faces, round(sum(s), 3) AS area FROM geo GROUP BY 1)
SELECT * FROM nv JOIN nf USING (mesh_id)"""


def summed(files: DataFrame) -> DataFrame:
    """mesh_id, vertices, sx, sy, sz, faces, area of the meshes that were read."""
    v, f = meshes.vertices(files), meshes.faces(files)
    corner = lambda n: v.select("mesh_id", F.col("vid").alias(n), F.struct("x", "y", "z").alias(f"p{n}"))
    tri = f.join(corner("a"), ["mesh_id", "a"]).join(corner("b"), ["mesh_id", "b"]).join(corner("c"), ["mesh_id", "c"])
    side = lambda p, x: F.col(f"p{p}.{x}") - F.col(f"pa.{x}")
    cross = [side("b", x) * side("c", y) - side("b", y) * side("c", x) for x, y in (("y", "z"), ("z", "x"), ("x", "y"))]
    area = F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2
    total = v.groupBy("mesh_id").agg(F.count("*").alias("vertices"), *(F.sum(c).alias(f"s{c}") for c in "xyz"))
    return rounded(total.join(tri.groupBy("mesh_id").agg(F.count("*").alias("faces"), F.sum(area).alias("area")), "mesh_id"), 3)


def written(spark, d, kind: str, fields: bool = False) -> DataFrame:
    """The grids as files of one kind, read back."""
    path, (v, f) = new_path(spark, kind), grids(spark, d)
    more = v.select("mesh_id", "vid", F.lit("height").alias("field"), F.col("z").alias("value")).unionByName(v.select("mesh_id", "vid", F.lit("id").alias("field"), F.col("vid").cast("double").alias("value"))) if fields else None
    meshes.write_files(v, f, path, kind, more).write.format("noop").mode("overwrite").save()
    return meshes.read_meshes(spark, path)


@query(WHOLE)
def stl_round_trip(spark, d):
    return summed(written(spark, d, "stl"))


@query(WHOLE)
def obj_round_trip(spark, d):
    return summed(written(spark, d, "obj"))


@query(WHOLE)
def vtp_round_trip(spark, d):
    return summed(written(spark, d, "vtp", True))


@query(f"WITH {GRID} SELECT mesh_id, vid, 'height' AS field, round(z, 6) + 0.0 AS value FROM vert UNION ALL SELECT mesh_id, vid, 'id', vid FROM vert")
def vtp_fields(spark, d):
    return rounded(meshes.vertex_fields(written(spark, d, "vtp", True)))


@query("SELECT 'm' AS mesh_id, (row_number() OVER (ORDER BY r_regionkey) - 1)::INT AS vid, r_regionkey / 10.0 AS x, r_regionkey * 2.0 AS y, length(r_name)::DOUBLE AS z FROM region")
def mesh_from_arrays(spark, d):
    """Arrays of the driver, here of the regions, as a mesh."""
    v = np.array([(r.r_regionkey / 10, r.r_regionkey * 2.0, len(r.r_name)) for r in read(spark, d, "region").orderBy("r_regionkey").collect()], float)
    return rounded(meshes.from_arrays(spark, "m", v, np.array([[0, 1, 2], [2, 3, 4]]))[0])


@query("SELECT c_nationkey AS list, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) - 1)::INT AS pos, c_custkey::INT AS label FROM customer")
def label_list(spark, d):
    """Vectors of labels in files of one array each, in their own order: a list per nation, written where its rows are."""
    path, rows = new_path(spark, "labels"), read(spark, d, "customer")
    tables.write_labels(rows, path, "c_nationkey", "c_custkey", F.desc("c_custkey"))
    found = tables.read_labels(spark, f"{path}/*.npy")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.npy$", 1).cast("int").alias("list"), "pos", "label")


@query("SELECT p_partkey::VARCHAR AS obs_name, p_brand, p_size::BIGINT AS p_size, p_retailprice, p_retailprice / p_size AS ratio FROM part")
def store_round_trip(spark, d):
    """A chunked store written from a table and read back, without the columns that aren't wanted."""
    path = new_path(spark, "store")
    rows = read(spark, d, "part").select("*", (F.col("p_retailprice") / F.col("p_size")).alias("ratio"), (F.col("p_size") * 2.0).alias("twice"))
    stores.write_table(rows, path, "p_partkey", ["p_retailprice", "twice", "ratio"], ["p_brand", "p_type", "p_size"], row_chunk=300, column_chunk=2)
    return stores.read_table(spark, path, var=["ratio", "p_retailprice"], obs=["p_brand", "p_size"]).drop("row")


@query("""WITH mesh AS (SELECT l_partkey::VARCHAR AS obs_name, l_partkey AS label, avg(l_discount) * 26 AS sphericity FROM lineitem GROUP BY ALL), feat AS (SELECT p_partkey::VARCHAR AS obs_name, p_size / 10.0 AS i FROM part)
SELECT obs_name, label::INT AS label FROM mesh LEFT JOIN feat USING (obs_name) WHERE NOT (coalesce(i < 1, false) OR coalesce(sphericity > 1.3, false))""")
def store_good_labels(spark, d):
    """The job that makes lists of good labels: a feature store and a mesh store, each read by the columns that the limits need."""
    features, shapes = new_path(spark, "features"), new_path(spark, "shapes")
    part = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") / 10.0).alias("C01.min_intensity"), "p_retailprice")
    stores.write_table(part, features, "name", ["p_retailprice", "C01.min_intensity"], row_chunk=512, column_chunk=1)
    mesh = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("label")).agg((F.avg("l_discount") * 26).alias("sphericity"), F.sum("l_quantity").alias("volume")).withColumn("name", F.col("label").cast("string"))
    stores.write_table(mesh, shapes, "name", ["volume", "sphericity"], ["label"], row_chunk=512)
    return tables.good_labels(stores.read_table(spark, features, ["C01.min_intensity"], []), stores.read_table(spark, shapes, ["sphericity"], ["label"]))


@query("SELECT n_name AS timepoint, count(*) AS n, sum(c_custkey)::BIGINT AS total, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def result_table_round_trip(spark, d):
    """A result table by timepoint, saved and read again."""
    path = new_path(spark, "results")
    rows = read(spark, d, "customer").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    tables.save(rows.select(F.col("n_name").alias("timepoint"), "c_custkey", "c_acctbal"), path, ("timepoint",))
    return rounded(spark.read.parquet(path).groupBy("timepoint").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("total"), F.sum("c_acctbal").alias("balance")), 2)


@query(f"WITH {CENTERS} SELECT 'centers' AS part, count(*) AS n, round(sum(list_sum(center)), 5) AS total FROM cen UNION ALL SELECT 'vectors', count(*), round(sum(list_sum(x)), 5) FROM emb")
def bundle_round_trip(spark, d):
    """Two tables of one result side by side."""
    path = new_path(spark, "bundle")
    tables.save_bundle(path, centers=centers(spark, d), vectors=vectors(spark, d))
    found = tables.load_bundle(spark, path, "centers", "vectors")
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda s, v: s + v)).alias("total")
    parts = [found[n].agg(F.count("*").alias("n"), total(c)).select(F.lit(n).alias("part"), "n", "total") for n, c in (("centers", "center"), ("vectors", "x"))]
    return rounded(parts[0].unionByName(parts[1]), 5)


@query(f"WITH {DIST} SELECT (SELECT count(*) FROM cen) AS words, round(sigma, 6) AS sigma, {[float(t) for t in TIMES]}::DOUBLE[] AS times FROM sig")
def vocabulary_round_trip(spark, d):
    path, c, v = new_path(spark, "vocabulary"), centers(spark, d), vectors(spark, d)
    tables.save_vocabulary(path, c, scaling.fit_array_scaler(v, "x"), clustering.bandwidth(v, c), TIMES)
    found = tables.load_vocabulary(spark, path, TIMES)
    return rounded(found["params"].crossJoin(found["centers"].agg(F.count("*").alias("words"))).select("words", "sigma", "times"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings")
def layout_csv_round_trip(spark, d):
    path = new_path(spark, "layout")
    tables.save_layout_csv(vectors(spark, d).select("vec_id", F.col("x").alias("y")), path, "vec_id")
    return rounded(spark.read.schema("vec_id bigint, x double, y double").option("header", True).csv(path))


def job_files(spark, d) -> str:
    """A folder with the grids as .vtp files with two fields, and a damaged file."""
    path, (v, f) = new_path(spark, "job"), grids(spark, d)
    fields = v.select("mesh_id", "vid", F.lit("height").alias("field"), F.col("z").alias("value")).unionByName(v.select("mesh_id", "vid", F.lit("id").alias("field"), F.col("vid").cast("double").alias("value")))
    meshes.write_files(v, f, path, "vtp", fields).write.format("noop").mode("overwrite").save()
    meshes.put(f"{path}/broken.vtp", b"<VTKFile><PolyData>")
    return path


@query(f"""WITH {MASS}, m AS (SELECT mesh_id, vid, sum(m) AS m FROM share GROUP BY ALL), t AS (SELECT mesh_id, sum(m) AS total FROM m GROUP BY 1), c AS (SELECT mesh_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vert GROUP BY 1),
s AS (SELECT mesh_id, sum(m * z) AS h, sum(m * vid) AS i, sum(m * (x - cx)) AS x, sum(m * (y - cy)) AS y, sum(m * (z - cz)) AS zz FROM m JOIN vert USING (mesh_id, vid) JOIN (SELECT mesh_id, x AS cx, y AS cy, z AS cz FROM c) USING (mesh_id) GROUP BY 1)
SELECT mesh_id, 9 AS modes, round(total / 100, 6) AS area, round(abs(h) / sqrt(total) / 10, 5) AS height, round(abs(i) / sqrt(total) / 10, 4) AS id, round(sqrt(x * x + y * y + zz * zz) / sqrt(total) / 100, 6) AS middle, 0.0::DOUBLE AS unsolved, 0.0::DOUBLE AS skew FROM s JOIN t USING (mesh_id)
UNION ALL SELECT 'broken', 0, NULL, NULL, NULL, NULL, NULL, NULL""")
def decompose_files(spark, d):
    """The whole job over files, one of them damaged; its bundle saved and read back, and checked by what it must hold.

    The first mode is constant, so the first coefficients are known: of both fields, and of the coordinates together. unsolved: how far any
    mode misses L phi = -lambda M phi, with the Laplacian and the masses of the joined tables; skew: how far any two miss being orthonormal.
    """
    out, found = new_path(spark, "bundle"), pipelines.decompose(spark, job_files(spark, d), lmax=3)
    tables.save_bundle(out, **{k: found[k] for k in ("basis", "coefficients", "vertices", "faces", "status")})
    got = tables.load_bundle(spark, out, "basis", "coefficients", "vertices", "faces", "status")
    c = got["coefficients"]
    first = c.where("mode = 0").groupBy("mesh_id").agg(F.max(F.when(F.col("channel") == "height", F.abs("c"))).alias("height"), F.max(F.when(F.col("channel") == "id", F.abs("c"))).alias("id"), F.sqrt(F.sum(F.when(F.col("channel").isin("x", "y", "z"), F.col("c") * F.col("c")))).alias("middle"))
    modes = harmonics.modes(got["basis"], "mesh_id", "mass").select("mesh_id", "vid", "mode", "p", "mass")
    lam = got["basis"].groupBy("mesh_id").agg(F.first("lambdas").alias("l"), F.sum("mass").alias("area"), F.first(F.size("phi")).alias("modes"))
    applied = geometry.cot_laplacian(got["vertices"].drop("rotation"), got["faces"]).join(modes.select("mesh_id", F.col("vid").alias("j"), "mode", "p"), ["mesh_id", "j"]).groupBy("mesh_id", F.col("i").alias("vid"), "mode").agg(F.sum(F.col("w") * F.col("p")).alias("lp"))
    miss = applied.join(modes, ["mesh_id", "vid", "mode"]).join(lam, "mesh_id").groupBy("mesh_id").agg(F.max(F.abs(F.col("lp") + F.get("l", F.col("mode")) * F.col("mass") * F.col("p"))).alias("unsolved"))
    pair = modes.alias("p").join(modes.alias("q"), ["mesh_id", "vid"]).groupBy("mesh_id", F.col("p.mode").alias("i"), F.col("q.mode").alias("j")).agg(F.sum(F.col("p.p") * F.col("q.p") * F.col("p.mass")).alias("s"))
    skew = pair.groupBy("mesh_id").agg(F.max(F.abs(F.col("s") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))).alias("skew"))
    good = first.join(lam.drop("l"), "mesh_id").join(miss, "mesh_id").join(skew, "mesh_id")
    place = {"area": 6, "height": 5, "id": 4, "middle": 6, "unsolved": 5, "skew": 5}
    good = good.select("mesh_id", "modes", *((F.round(k, n) + F.lit(0.0)).alias(k) for k, n in place.items()))
    bad = got["status"].select("mesh_id", F.lit(0).alias("modes"), *(F.lit(None).cast("double").alias(k) for k in place))
    return good.unionByName(bad)


@query("SELECT 'read' AS stage, count(*) AS rows, 1::BIGINT AS failed, true AS timed FROM nation UNION ALL SELECT 'align', count(*) * 64, 0, true FROM nation UNION ALL SELECT 'eigenbasis', count(*) * 64, 0, true FROM nation")
def job_stages(spark, d):
    """Rows, failures and times of the job's stages, as they were counted on the way."""
    stages = pipelines.Stages()
    pipelines.decompose(spark, job_files(spark, d), lmax=2, stages=stages)
    return stages.table(spark).select("stage", "rows", "failed", (F.col("seconds") > 0).alias("timed"))


@query("SELECT user_id, event_type, min(ts)::TIMESTAMP AS first FROM events GROUP BY ALL")
def stream_first_seen(spark, d):
    """Items of a stream that haven't been seen before, over two batches of the same files: the second one finds everything done."""
    return ingest.first_seen_table(spark, read(spark, d, "events"), ["user_id", "event_type"], "ts", new_path(spark, "seen"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark, d):
    return ingest.sessions(read(spark, d, "events"), "ts", "user_id").select("user_id", "start", "end", "n")
