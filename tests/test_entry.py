"""The entry in a fresh process: no session yet, another folder, the repository on the driver's path alone."""

import os
import subprocess
import sys

from conftest import ROOT


def fresh(code: str, folder) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {ROOT!r})\n{code}"], cwd=folder, env=env, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-3000:]
    return run.stdout


def test_imports_without_a_session(tmp_path):
    out = fresh("import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) - set(e.queries()))", tmp_path)
    assert int(out.split()[0]) > 80 and out.split()[1] == "set()"


def test_flagship_runs_first_of_all(tmp_path):
    out = fresh(
        "from pyspark.sql import SparkSession\nimport __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('rows', e.entry(s).count())",
        tmp_path,
    )
    assert int(out.split("rows ")[1]) > 0
