"""Code that runs away from the repository: a driver elsewhere that has only put the repository on its own path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

DRIVER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
print("ROWS", e.queries()["run_segments"](spark, "/root/testdata/sf0.001").count())
"""


def test_executors_get_the_code(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", DRIVER.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS" in said.stdout, said.stderr[-2000:]
    assert int(said.stdout.split("ROWS")[1]) > 0
