"""Scratch folders: without any setting, after the session has stopped, and without changing settings."""

import os
import subprocess
import sys

CODE = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1")
for given in sys.argv[1:]:
    spark = spark.config("spark.checkpoint.dir", given)
spark = spark.getOrCreate()
from narae.session import materialise, scratch_path
settings = lambda: {r.key: r.value for r in spark.sql("set").collect() if r.value != "false"}
before = settings()
assert materialise(spark.range(3), "three").count() == 3
assert settings() == before
root = os.path.dirname(scratch_path(spark, "x"))
assert os.path.isdir(root)
spark.stop()
print(root)
"""


def _run(folder, *args):
    """With an empty configuration folder: nothing is set but the arguments."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE, *args], check=True, capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": str(folder)}, timeout=300)
    return done.stdout.strip().splitlines()[-1]


def test_no_folder_given(tmp_path):
    assert not os.path.exists(_run(tmp_path))


def test_folder_given(tmp_path):
    root = _run(tmp_path, str(tmp_path / "scratch"))
    assert root.startswith(str(tmp_path)) and not os.path.exists(root)
