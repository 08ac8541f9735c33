"""Every registered query against its SQL in DuckDB where it has one, and what no plan may contain."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert forbidden not in plan
    got = df.toPandas()
    if name in ORACLES:
        assert differences(got, duck.execute(ORACLES[name]).df()) is None
    else:
        # What SQL cannot express is compared with brute force elsewhere; here it has its columns and rows.
        assert list(got.columns) == df.columns and len(got) > 0


def test_entry_is_the_hourly_rollup(spark):
    assert entry.entry(spark).columns == ["asset_id", "timestamp", "open", "high", "low", "close", "volume"]
