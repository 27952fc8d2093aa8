"""The driver's contract."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(entry.__file__).resolve().parent
#: Runs queries by name in a session of its own and prints the rows of each.
ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as entry
conf = {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
for name in sys.argv[3:]:
    print(name, entry.queries()[name](spark, sys.argv[2]).count())
"""


def rows_elsewhere(folder, *names):
    """The row counts of queries that run where workers cannot import the repository."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ELSEWHERE, str(HERE), "/root/testdata/sf0.001", *names], cwd=folder, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-3000:]
    return {k: int(v) for k, v in (line.split() for line in out.stdout.splitlines() if line.startswith(names))}


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_events(spark):
    assert entry.entry(spark).count() > 0


def test_workers_get_the_package(tmp_path):
    assert rows_elsewhere(tmp_path, "fit_dmdc_moments", "event_hours")["event_hours"] > 0
