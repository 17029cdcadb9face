"""The sparse solve and the walks against dense algebra and plain loops."""

import numpy as np
from pyspark.sql import functions as F

from spectramesh.kernels import sphere
from spectramesh.kernels.eigen import dense, operator
from spectramesh.operators import geometry, iterate


def sheet(n, bend):
    """An n x n sheet of triangles, bent."""
    v = np.array([(i + 0.2 * np.sin(j * bend), j + 0.3 * np.sin(i * bend), np.sin(0.5 * i) * np.cos(0.4 * j * bend)) for i in range(n) for j in range(n)])
    f = [t for i in range(n - 1) for j in range(n - 1) for a in [i * n + j] for t in ((a, a + n, a + 1), (a + 1, a + n, a + n + 1))]
    return v, np.array(f)


def frames(spark, meshes):
    v = [(m, i, *map(float, p)) for m, (x, _) in meshes.items() for i, p in enumerate(x)]
    f = [(m, i, *map(int, t)) for m, (_, y) in meshes.items() for i, t in enumerate(y)]
    return spark.createDataFrame(v, "mesh_id string, vid int, x double, y double, z double"), spark.createDataFrame(f, "mesh_id string, fid int, a int, b int, c int")


def test_dirichlet_is_the_dense_solution(spark):
    meshes = {"a": sheet(4, 1), "b": sheet(5, 2), "free": sheet(3, 1)}
    v, f = frames(spark, meshes)
    given = {"a": {0: 0.0, 15: np.pi}, "b": {0: 1.0, 5: -2.0, 24: 3.0}}
    fixed = spark.createDataFrame([(m, k, x) for m, g in given.items() for k, x in g.items()], "mesh_id string, vid int, value double")
    x, report = iterate.dirichlet(geometry.cot_laplacian(v, f), fixed, tol=1e-12)
    got = {(r.mesh_id, r.vid): r.x for r in x.collect()}
    assert len(got) == sum(len(p) for p, _ in meshes.values())
    for m, g in given.items():
        points, tri = meshes[m]
        i, j, w, _ = operator(points, tri)
        at, values, l = np.array(list(g)), np.array(list(g.values())), dense(i, j, w, len(points))
        want, rest = np.zeros(len(points)), np.setdiff1d(np.arange(len(points)), at)
        want[at] = values
        want[rest] = np.linalg.solve(-l[np.ix_(rest, rest)], l[np.ix_(rest, at)] @ values)
        off = i != j
        assert np.allclose(sphere.dirichlet(i[off], j[off], w[off], len(points), at, values), want, atol=1e-9)
        assert np.allclose([got[m, k] for k in range(len(points))], want, atol=1e-9)
    assert all(got["free", k] == 0 for k in range(9))
    assert all(r.residual <= 1e-12 and r.rounds < 200 for r in report.collect())
    _, late = iterate.dirichlet(geometry.cot_laplacian(v, f), fixed, rounds=2)
    assert max(r.residual for r in late.collect()) > 1e-3


def test_walks(spark):
    rng = np.random.default_rng(2)
    meshes = {"a": sheet(6, 1), "b": sheet(7, 3)}
    _, f = frames(spark, meshes)
    h = {(m, i): float(rng.integers(0, 30)) for m, (p, _) in meshes.items() for i in range(len(p))}
    heights = spark.createDataFrame([(*k, x) for k, x in h.items()], "mesh_id string, vid int, h double")
    nexts = iterate.highest_neighbour(geometry.edges(f), heights)
    near = {}
    for r in geometry.adjacency(f).collect():
        near[r.mesh_id, r.vid] = r.neighbours
    step = {}
    for (m, v), ns in near.items():
        top = min(ns, key=lambda n: (-h[m, n], n))
        step[m, v] = top if h[m, top] > h[m, v] else v
    assert {(r.mesh_id, r.vid): r.next for r in nexts.collect()} == step
    starts = heights.groupBy("mesh_id").agg(F.min(F.struct("h", "vid"))["vid"].alias("vid"))
    way, tops = iterate.walks(nexts, starts)
    for m, s in {r.mesh_id: r.vid for r in starts.collect()}.items():
        want = [s]
        while step[m, want[-1]] != want[-1]:
            want.append(step[m, want[-1]])
        assert [r.vid for r in way.where(F.col("mesh_id") == m).orderBy("step").collect()] == want
    for r in tops.collect():
        v, n = r.vid, 0
        while step[r.mesh_id, v] != v:
            v, n = step[r.mesh_id, v], n + 1
        assert (r.top, r.steps) == (v, n)


def test_a_long_way(spark):
    """A line of 1,000 vertices is walked from end to end."""
    nexts = spark.range(1000).select(F.lit("m").alias("mesh_id"), F.col("id").cast("int").alias("vid"), F.least(F.col("id") + 1, F.lit(999)).cast("int").alias("next"))
    way, tops = iterate.walks(nexts, spark.createDataFrame([("m", 3)], "mesh_id string, vid int"))
    assert [r.vid for r in way.orderBy("step").collect()] == list(range(3, 1000))
    assert tops.where("top <> 999 or steps <> 999 - vid").count() == 0
