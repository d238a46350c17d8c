"""Python workers get the package, wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from avsync.operators import folds
from avsync.session import tune
tune(tune(spark))
rows = spark.createDataFrame([("v", float(t), t) for t in range(20)], "video_id string, t double, ord int")
print("kept", sorted(r.t for r in folds.suppress_close(rows).collect()))
"""


def test_workers_import_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "kept [0.0, 5.0, 10.0, 15.0]" in out.stdout, out.stderr[-2000:]
