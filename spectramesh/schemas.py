"""The tables' fixed schemas. Fields and channels are data (long form), never columns."""

from __future__ import annotations

MESH_VERTICES = "mesh_id string, vid int, x double, y double, z double"
MESH_FACES = "mesh_id string, fid int, a int, b int, c int"
VERTEX_FIELDS = "mesh_id string, vid int, field string, value double"
MESH_FILES = "mesh_id string, path string, vertices array<struct<x:double,y:double,z:double>>, faces array<struct<a:int,b:int,c:int>>, fields array<struct<field:string,values:array<double>>>, status string, error string"
EIGENVALUES = "mesh_id string, mode int, lambda double"
EIGENVECTORS = "mesh_id string, vid int, mass double, phi array<double>"
COEFFICIENTS = "mesh_id string, kind string, channel string, mode int, c double"
SPECTRA = "mesh_id string, l int, channel string, power double"
GOOD_LABELS = "timepoint string, well string, pos int, label int"
PLATE_LAYOUT = "timepoint string, zarr string, well string, round string, mesh_name string"
VOCABULARY = "cluster int, center array<double>"
SCALER = "dim int, mean double, std double"
MI_MATRIX = "timepoint string, field_i string, field_j string, mi double, mi_raw double"
SH_COEFFICIENTS = "mesh_id string, axis int, sign int, l int, m int, value double"
STATUS = "mesh_id string, status string, error string"
