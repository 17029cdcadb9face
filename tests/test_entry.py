"""The driver's contract, with and without the optional subpackage."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_without_optional_parts(tmp_path):
    """A copy without the pipeline and the subpackage still imports, lists its queries and runs one."""
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession

s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print(len(e.queries()), any(q.startswith("op1_") or q == "pipeline" for q in e.queries()), e.queries()["count_by"](s, "/root/testdata/sf0.001").count() > 0, set(e.oracle_sql()) <= set(e.queries()))
"""
    for part in ("__spark_entry__.py", "spectramesh"):
        subprocess.run(["cp", "-r", ROOT / part, tmp_path / part], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "spectramesh/llm"], check=True)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, *said = out.stdout.split()
    assert int(n) > 80 and said == ["False", "True", "True"]
