"""Every query of the subpackage on workers that cannot import the library."""

import os
import subprocess
import sys

from conftest import ROOT

CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
     .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "3g").getOrCreate())
def absent(rows):
    try:
        import corvia
    except ImportError:
        yield from rows
assert s.sparkContext.parallelize(range(3), 1).mapPartitions(absent).count() == 3
for name, f in e.queries().items():
    if name.startswith("op"):
        print(name, f(s, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_each_query_runs_where_the_library_is_not(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stdout + run.stderr[-3000:]
    rows = dict(line.rsplit(" ", 1) for line in run.stdout.splitlines() if line.startswith("op"))
    assert len(rows) >= 10 and all(int(n) > 0 for n in rows.values())
