"""Known answers for meshes: closed forms, spheres, and invariance under rigid motion."""

import math
import struct
import zlib
from base64 import b64encode

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectramesh.functions import columns as C
from spectramesh.kernels import eigen, embed, harmonic_fit, sphere
from spectramesh.operators import geometry, harmonics
from spectramesh.plans import pipelines
from spectramesh.sources import meshes, tables


def icosphere(times=2):
    g = (1 + 5**0.5) / 2
    v = [(-1, g, 0), (1, g, 0), (-1, -g, 0), (1, -g, 0), (0, -1, g), (0, 1, g), (0, -1, -g), (0, 1, -g), (g, 0, -1), (g, 0, 1), (-g, 0, -1), (-g, 0, 1)]
    v = [np.array(x) / np.linalg.norm(x) for x in v]
    d = lambda a, b: np.linalg.norm(v[a] - v[b])
    f = [(a, b, c) for a in range(12) for b in range(a + 1, 12) for c in range(b + 1, 12) if max(d(a, b), d(b, c), d(a, c)) < 1.1]
    f = [t if np.dot(np.cross(v[t[1]] - v[t[0]], v[t[2]] - v[t[0]]), v[t[0]]) > 0 else (t[0], t[2], t[1]) for t in f]
    for _ in range(times):
        mid, out = {}, []
        for t in f:
            m = []
            for p, q in ((0, 1), (1, 2), (2, 0)):
                k = tuple(sorted((t[p], t[q])))
                if k not in mid:
                    mid[k] = len(v)
                    x = v[k[0]] + v[k[1]]
                    v.append(x / np.linalg.norm(x))
                m.append(mid[k])
            out += [(t[0], m[0], m[2]), (m[0], t[1], m[1]), (m[2], m[1], t[2]), tuple(m)]
        f = out
    return np.array(v), np.array(f)


SPHERE = icosphere()


def test_sphere_eigenvalues():
    values, vectors, mass = eigen.lowest(*SPHERE, 16)
    assert abs(mass.sum() - 12.4) < 0.2
    want = [l * (l + 1) for l in range(4) for _ in range(2 * l + 1)]
    assert np.abs(values - want).max() < 0.8 and values[0] < 1e-9
    assert np.allclose(vectors.T @ (mass[:, None] * vectors), np.eye(16), atol=1e-9)
    i, j, w, _ = eigen.operator(*SPHERE)
    l = eigen.dense(i, j, w, len(mass))
    assert np.allclose(-l @ vectors, mass[:, None] * vectors * values, atol=1e-8) and np.allclose(l, l.T) and np.allclose(l.sum(1), 0)


def test_filtered_iteration_agrees_with_dense():
    a, b = eigen.lowest(*SPHERE, 9)[0], eigen.lowest(*SPHERE, 9, dense_limit=10)[0]
    assert np.allclose(a, b, atol=1e-6)


def test_rigid_motion_and_scale():
    v, f = SPHERE
    v = v * [1, 1.2, 1.7]
    q, _ = np.linalg.qr(np.random.default_rng(0).normal(size=(3, 3)))
    a, pa, ma = eigen.lowest(v, f, 9)
    b, pb, mb = eigen.lowest(v @ q.T + 5, f, 9)
    c = eigen.lowest(3 * v, f, 9)[0]
    assert np.allclose(a, b, atol=1e-8) and np.allclose(a[1:] / 9, c[1:], rtol=1e-6)
    hks = lambda p, x: (np.exp(-0.5 * x) * p**2).sum(1)
    assert np.allclose(hks(pa, a), hks(pb, b), atol=1e-8) and np.allclose(ma, mb)


def test_geometry_matches_kernel(spark):
    v, f = icosphere(1)
    v = v * [1, 1, 3]  # obtuse faces
    vs, fs = meshes.from_arrays(spark, "m", v, f)
    i, j, w, mass = eigen.operator(v, f)
    l = eigen.dense(i, j, w, len(v))
    got = {(r.i, r.j): r.w for r in geometry.cot_laplacian(vs, fs).collect()}
    assert all(abs(l[k] - x) < 1e-9 for k, x in got.items()) and np.count_nonzero(np.abs(l) > 1e-12) <= len(got)
    assert np.allclose([r.mass for r in geometry.voronoi_mass(vs, fs).orderBy("vid").collect()], mass)
    assert abs(mass.sum() - geometry.face_areas(vs, fs).agg(F.sum("area")).first()[0]) < 1e-9
    assert geometry.edges(fs).count() == len(v) + len(f) - 2
    n = np.array([(r.x, r.y, r.z) for r in geometry.vertex_normals(vs, fs).orderBy("vid").collect()])
    assert np.allclose(n, sphere.normals(v, f))


def test_tetrahedron(spark):
    v = np.array([[1, 1, 1], [1, -1, -1], [-1, 1, -1], [-1, -1, 1]], float)
    f = np.array([[0, 1, 2], [0, 3, 1], [0, 2, 3], [1, 3, 2]])
    vs, fs = meshes.from_arrays(spark, "t", v, f)
    assert {round(r.area, 9) for r in geometry.face_areas(vs, fs).collect()} == {round(2 * 3**0.5, 9)}
    w = {(r.i, r.j): r.w for r in geometry.cot_laplacian(vs, fs).collect()}
    assert abs(w[0, 1] - 1 / 3**0.5) < 1e-12 and abs(w[0, 0] + 3**0.5) < 1e-12


def test_pipeline_from_files(spark, tmp_path):
    v, f = icosphere(1)
    (tmp_path / "a.obj").write_text(meshes.obj_text(v * [1, 1, 2], f))
    (tmp_path / "bad.stl").write_bytes(b"nothing")
    (tmp_path / "small.obj").write_text(meshes.obj_text(v[:3], np.array([[0, 1, 2]])))
    found = pipelines.decompose(spark, [str(tmp_path / n) for n in ("a.obj", "bad.stl", "small.obj")], lmax=3, times=[0.1, 1.0])
    assert {r.mesh_id for r in found["status"].collect()} == {"bad", "small"}
    basis = found["basis"].cache()
    assert basis.count() == len(v)
    spectrum = harmonics.band_power(found["coefficients"], 3)
    assert {r.channel for r in spectrum.collect()} == {"x", "y", "z", "hks-0", "hks-1"}
    points = found["vertices"].select("mesh_id", "vid", F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("value")) for c in "xyz"))))
    curve = [r.error for r in harmonics.recon_error_curve(basis, found["coefficients"].where("kind = 'v'"), points, 3).orderBy("l").collect()]
    assert curve[0] > curve[2] + 0.1 and curve[2] >= curve[3] - 1e-9 and len(curve) == 4
    tables.save_bundle(str(tmp_path / "out"), basis=basis)
    assert tables.load_bundle(spark, str(tmp_path / "out"), "basis")["basis"].count() == len(v)
    with pytest.raises(ValueError):
        harmonics.reconstruct(basis, found["coefficients"], 4, available=3)
    assert {r.value for r in harmonics.reconstruct(basis, found["coefficients"].where("kind = 'v'"), 0).collect()} == {0.0}


def stl(v, f):
    out = b"x" * 80 + struct.pack("<I", len(f))
    for t in f:
        out += struct.pack("<12fH", 0, 0, 0, *v[t].astype("f4").ravel(), 0)
    return out


def vtp(v, f, how="ascii", extra=""):
    def data(name, x, kind, n=1):
        if how == "ascii":
            return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="ascii">{" ".join(map(str, x.ravel().tolist()))}</DataArray>'
        raw = x.tobytes()
        if how == "zlib":
            z = zlib.compress(raw)
            body = b64encode(struct.pack("<4I", 1, len(raw), 0, len(z))) + b64encode(z)
        else:
            body = b64encode(struct.pack("<I", len(raw)) + raw)
        return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{n}" format="binary">{body.decode()}</DataArray>'

    head = ' compressor="vtkZLibDataCompressor"' if how == "zlib" else ""
    return (
        f'<VTKFile type="PolyData" byte_order="LittleEndian" header_type="UInt32"{head}><PolyData><Piece><Points>{data("Points", v.astype("f8"), "Float64", 3)}</Points><Polys>{data("connectivity", f.astype("i8"), "Int64")}{data("offsets", np.arange(3, 3 * len(f) + 1, 3), "Int64")}</Polys>'
        f'<PointData>{data("mark", np.arange(len(v)) / 2, "Float64")}</PointData></Piece></PolyData></VTKFile>'
    ).encode()


def test_mesh_files(spark, tmp_path):
    v, f = icosphere(0)
    a, b, _ = meshes.parse("m.stl", stl(v, f))
    assert np.allclose(a[b], v[f], atol=1e-6) and len(a) == 12
    text = "solid s\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join("vertex %r %r %r\n" % tuple(v[k].tolist()) for k in t) + "endloop\nendfacet\n" for t in f) + "endsolid"
    a, b, _ = meshes.parse("m.STL", text.encode())
    assert np.allclose(a[b], v[f])
    a, b, _ = meshes.parse("m.obj", b"v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 -1\n")
    assert b.tolist() == [[0, 1, 2], [0, 2, 3]]
    for how in ("ascii", "base64", "zlib"):
        a, b, fields = meshes.parse("m.vtp", vtp(v, f, how))
        assert np.allclose(a, v) and b.tolist() == f.tolist() and fields["mark"].tolist() == [k / 2 for k in range(12)]
    with pytest.raises(ValueError):
        meshes.parse("m.ply", b"")
    (tmp_path / "one.vtp").write_bytes(vtp(v, f))
    got = meshes.read_meshes(spark, str(tmp_path))
    assert meshes.vertices(got).count() == 12 and meshes.faces(got).count() == 20
    assert meshes.vertex_fields(got).where("field = 'mark' and vid = 3").first().value == 1.5
    meshes.write_obj(meshes.vertices(got), meshes.faces(got), str(tmp_path / "obj"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "obj")).where("mesh_id = 'one'").collect())
    assert text.count("v ") == 12 and text.count("f ") == 20


def test_arrays_and_vocabulary(spark, tmp_path):
    np.save(tmp_path / "good_labels.npy", np.array([5, 3, 9]))
    np.savez(tmp_path / "b.npz", x=np.eye(2), n=np.array(["a"]))
    assert [(r.pos, r.label) for r in tables.read_labels(spark, str(tmp_path / "good_labels.npy")).orderBy("pos").collect()] == [(0, 5), (1, 3), (2, 9)]
    assert [(r.name, list(r.shape)) for r in tables.read_arrays(spark, str(tmp_path / "b.npz")).collect()] == [("x", [2, 2])]
    one = spark.createDataFrame([(0, [1.0])], "cluster int, center array<double>")
    tables.save_vocabulary(str(tmp_path / "v"), one, spark.createDataFrame([([0.0], [1.0])], "mean array<double>, std array<double>"), spark.createDataFrame([(2.0,)], "sigma double"), [1.0, 2.0])
    assert tables.load_vocabulary(spark, str(tmp_path / "v"), [1.0, 2.0])["params"].first().sigma == 2.0
    with pytest.raises(ValueError):
        tables.load_vocabulary(spark, str(tmp_path / "v"), [1.0, 3.0])
    tables.save_layout_csv(spark.createDataFrame([("a", [1.0, 2.0])], "id string, y array<double>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().asDict() == {"id": "a", "x": "1.0", "y": "2.0"}


def test_sphere_map():
    v, f = SPHERE
    v = v * [1.5, 1, 1]
    theta, phi = sphere.initial_angles(v, f)
    assert theta[np.argmax(v[:, 0])] == 0 and abs(theta[np.argmin(v[:, 0])] - np.pi) < 1e-12
    assert (theta >= -1e-9).all() and (theta <= np.pi + 1e-9).all() and (phi >= -1e-9).all() and (phi <= 2 * np.pi + 1e-9).all()
    assert phi.max() - phi.min() > 5
    terms, x = sphere.Terms.of(v, f), np.random.default_rng(0).normal(size=v.shape)
    la, ln = np.random.default_rng(1).normal(size=len(f)), np.random.default_rng(2).normal(size=len(v))
    g, step = terms.gradient(x, la, ln, 3.0), np.zeros_like(x)
    for k in range(5):
        step[:] = 0
        step[k, k % 3] = 1e-6
        slope = (terms.value(x + step, la, ln, 3.0) - terms.value(x - step, la, ln, 3.0)) / 2e-6
        assert abs(slope - g[k, k % 3]) < 1e-4 * max(1, abs(slope))
    start = sphere.optimize(v, f, theta, phi, 1, 1)
    end = sphere.optimize(v, f, theta, phi, 8, 100)
    assert end[2] < start[2] and end[3] < 0.5


def test_harmonic_fit():
    lat, lon = np.degrees(np.arcsin(np.linspace(-0.99, 0.99, 400))), np.arange(400) * 137.5 % 360
    a, names = harmonic_fit.design(lat, lon, 3)
    assert a.shape == (400, 16) and np.allclose(a[:, 0], 1) and np.allclose(a[:, names.index((0, 1, 0))], 3**0.5 * np.sin(np.radians(lat)))
    assert np.allclose(a[:, names.index((0, 1, 1))], 3**0.5 * np.cos(np.radians(lat)) * np.cos(np.radians(lon)))
    assert np.abs(a.T @ a / 400 - np.eye(16)).max() < 0.12  # 4 pi normalised: mean square one
    want = np.random.default_rng(0).normal(size=(16, 3))
    assert np.allclose(harmonic_fit.fit_mesh(a @ want, lat, lon, 3)[0], want)


def test_layouts():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (40, 10)), rng.normal(8, 1, (40, 10))])
    for y in (embed.tsne(x, steps=300), embed.mds(x)[0], embed.pca(x, 2)):
        a, b = y[:40], y[40:]
        assert np.linalg.norm(a.mean(0) - b.mean(0)) > 2 * max(a.std(), b.std())
    stress = embed.mds(x)[1]
    assert all(p >= q - 1e-9 for p, q in zip(stress, stress[1:]))
    c, p = rng.normal(size=(5, 3)), rng.normal(size=3)
    assert np.allclose(embed.from_distances(c, np.linalg.norm(c - p, axis=1)), p)
    assert abs(np.linalg.norm(embed.from_distances(c[:1], np.array([2.0])) - c[0]) - 2) < 1e-12


def test_columns(spark):
    assert np.allclose(C.digamma_table(4), [-0.5772156649, 0.4227843351, 0.9227843351, 1.2561176684])
    row = spark.range(1).select(C.digamma(F.lit(50)).alias("p"), C.digamma(F.lit(8), 2).alias("q"), C.soft_assignment(F.lit(0.5), F.lit(2.0)).alias("e")).first()
    assert abs(row.p - 3.9019896734278925) < 1e-12 and abs(row.q - C.digamma_table(8)[-1] / math.log(2)) < 1e-12
    assert abs(spark.range(1).select(C.inverse_soft_assignment(F.lit(row.e), F.lit(2.0))).first()[0] - 0.5) < 1e-9
    with pytest.raises(ValueError):
        C.amplitude("x", mode="root_over_area")
