"""The driver's module works with the training-data subpackage deleted, and jobs run where workers cannot import the library."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def _run(code, cwd):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)


@pytest.mark.parametrize("gone", [["millrace/llm", "tests/llm"], ["millrace/llm", "tests/llm", "corpus_pipeline.py"]])
def test_the_rest_stands_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    done = _run("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(o) <= set(q); assert not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert 'pipeline' not in q", copy)
    assert done.returncode == 0, done.stderr[-2000:]


def test_ratio_runs_on_workers_without_the_library(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from millrace.operators import matching
rows = spark.createDataFrame([("abcd", "bcde")], "a string, b string")
assert matching.with_ratio(rows, "a", "b").first().ratio == 0.75
"""
    done = _run(code, tmp_path)
    assert done.returncode == 0, done.stderr[-2000:]
