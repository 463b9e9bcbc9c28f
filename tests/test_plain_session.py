"""The driver calls the entry points from its own session and working directory: Python workers must not need
to import the package (it is shipped by value with the functions that run there)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "Asia/Kolkata").getOrCreate())
import __spark_entry__ as e
print("entry", e.entry(spark).count())
q = e.queries()
print("brute", q["incidents_brute_force"](spark, "/root/testdata/sf0.001").count())
print("stream", q["stream_brute_force"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_points_from_a_plain_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    lines = dict(line.split() for line in out.stdout.splitlines() if line.split()[0] in ("entry", "brute", "stream"))
    assert int(lines["entry"]) > 0, out.stderr[-2000:]
    assert lines["brute"] == lines["stream"] == "12", out.stderr[-2000:]
