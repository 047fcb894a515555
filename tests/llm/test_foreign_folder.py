"""The operators' Python code reaches workers that cannot import the library."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent


def test_language_toxicity_and_tokens_without_the_library_on_workers(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from millrace.llm import langid, packing, toxicity
import public_tokenizers
rows = [(k, "some words of one tongue" if k % 2 else "ganz andere sehr lange worte", "en" if k % 2 else "de", "s") for k in range(40)]
docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
assert langid.accept(docs).count() == 40
assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 40
assert packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 40
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
