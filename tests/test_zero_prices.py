"""Queries over derived pages against their SQL, on a table with events of value 0.0."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import DEFAULT_SF_DIR, TABLES, connect, differences


@pytest.fixture(scope="module")
def zeros(spark, tmp_path_factory):
    """A copy of the small tables in which every third event is worth nothing."""
    folder = tmp_path_factory.mktemp("zeros")
    for name in TABLES:
        shutil.copy(f"{DEFAULT_SF_DIR}/{name}.parquet", folder)
    events = spark.read.parquet(f"{DEFAULT_SF_DIR}/events.parquet")
    value = F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value"))
    events.withColumn("value", value).toPandas().to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    ["rest_page", "rest_page_candles", "gap_repair_quarantine", "gap_repair_ledger", "gap_repair_flow", "gap_repair_coverage", "gap_repair_tiers"],
)
def test_prices_of_nothing_survive_their_page(spark, zeros, name):
    expected = connect(zeros).execute(entry.oracle_sql()[name]).df()
    assert differences(entry.queries()[name](spark, zeros).toPandas(), expected) is None
