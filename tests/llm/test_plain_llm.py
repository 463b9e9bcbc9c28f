"""All queries of this package and the pipeline from a plain session in another folder: workers must not need to import
the package, and every query without SQL names a test that exists."""

import os
import re
import subprocess
import sys

from incidentry.llm.queries import BRUTE_FORCE_TESTS, ORACLES, QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config(
    "spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
for name, query in e.queries().items():
    if name == "pipeline" or name.startswith("op"):
        if name != "open_incidents":
            print("rows", name, len(query(spark, "/root/testdata/sf0.001").collect()))
"""


def test_all_queries_from_a_plain_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=900)
    rows = {x.split()[1]: int(x.split()[2]) for x in out.stdout.splitlines() if x.startswith("rows ")}
    assert set(rows) == {*QUERIES, "pipeline"}, out.stderr[-3000:]
    assert all(rows.values())


def test_queries_without_sql_name_a_test():
    assert set(BRUTE_FORCE_TESTS) == set(QUERIES) - set(ORACLES)
    for where in BRUTE_FORCE_TESTS.values():
        path, name = where.split("::")
        assert re.search(rf"^def {name}\(", open(os.path.join(REPO, path)).read(), re.M), where
