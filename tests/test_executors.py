"""Counters of micro-batches where several executors share the work, in a session of its own."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile

from tests.compare import DEFAULT_SF_DIR

# Each executor holds cached blocks of its own, so a block may be computed more than once.
SCRIPT = """
import sys
import __spark_entry__ as entry
from tests.compare import connect, differences
from wickmill import build_session

sf_dir, shared = sys.argv[1:]
spark = build_session("executors", "local-cluster[3,2,1024]", **{
    "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.executor.memory": "1g", "spark.checkpoint.dir": shared})
problem = differences(entry.queries()["stream_audit"](spark, sf_dir).toPandas(), connect(sf_dir).execute(entry.oracle_sql()["stream_audit"]).df())
print("PROBLEM", problem)
spark.stop()
"""


def test_counters_do_not_depend_on_how_often_a_block_is_computed():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, DEFAULT_SF_DIR, shared], cwd=root, capture_output=True, text=True, timeout=600, check=False
    )
    assert "PROBLEM None" in done.stdout, done.stdout[-2000:] + done.stderr[-2000:]
