"""Python workers find the package when the driver starts elsewhere."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
from barloom.plans import inputs
from barloom.operators.gram import moments
bars = inputs.trade_bars(spark, "/root/testdata/sf0.001")
print("ROWS", moments(bars, ["close", "volume"], ["symbol"]).count())
"""


def test_started_from_another_folder(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240
    )
    assert "ROWS 18" in out.stdout, out.stderr[-2000:]
