"""Bad times are refused and never fail a job; merges leave base files alone; exports leave the session alone."""

from __future__ import annotations

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from wickmill.functions.failures import error_category
from wickmill.functions.time import from_epoch_ms
from wickmill.operators.messages import message_report
from wickmill.plans.refresh import base_path, merge_staged, staging_path
from wickmill.schemas import CANDLE_COLUMNS
from wickmill.sources.klines import parse_klines
from wickmill.sources.outputs import export_parquet
from wickmill.sources.tables import insert_ignore, stored_days

OVERFLOW = 9_223_372_036_854_775_807
YEAR_10000 = 253_402_300_800_000


def message(**changes):
    kline = {"t": 1_706_000_040_000, "T": 1_706_000_099_999, "s": "BTCUSDT", "i": "1m", "o": "1", "h": "2", "l": "1", "c": "2", "v": "3", "n": 4, "x": True}
    outer = {"e": "kline", "E": changes.pop("E", 1_706_000_100_000), "s": "BTCUSDT", "k": {**kline, **changes}}
    return json.dumps(outer)


def test_times_outside_the_calendar_are_null(spark):
    values = [OVERFLOW, -OVERFLOW, YEAR_10000, YEAR_10000 - 1, 0, None]
    rows = spark.createDataFrame([(v,) for v in values], "ms long").select(from_epoch_ms("ms").cast("string").alias("t")).collect()
    assert [r.t is None for r in rows] == [True, True, True, False, False, True]


def test_messages_with_bad_times_do_not_stop_the_others(spark):
    texts = [message(), message(t=OVERFLOW), message(t=YEAR_10000), message(E=OVERFLOW)]
    got = parse_klines(spark.createDataFrame([(t,) for t in texts], "value string")).select("timestamp", "event_time", "reject_reason").collect()
    assert [r.reject_reason is None for r in got] == [True, False, False, True]
    assert got[3].event_time is None and got[3].timestamp is not None


@pytest.mark.parametrize(
    "name, wanted",
    [
        ("ConnectTimeout", "NETWORK"),
        ("ConnectionResetError", "NETWORK"),
        ("BrokenPipeError", "NETWORK"),
        ("httpx.RequestError", "NETWORK"),
        ("json.decoder.JSONDecodeError", "VALIDATION"),
        ("sqlalchemy.exc.OperationalError", "DATABASE"),
        ("KeyError", "TRANSIENT"),
    ],
)
def test_failure_names_with_modules_and_subclasses(spark, name, wanted):
    row = spark.range(1).select(error_category(F.lit(name), F.lit("x")).alias("c")).first()
    assert row.c == wanted


def candles(spark, *rows):
    made = [(a, datetime(2024, 1, d, 0, m, tzinfo=timezone.utc), p, p, p, p, 1.0) for a, d, m, p in rows]
    return spark.createDataFrame(made, "asset_id int, timestamp timestamp, open double, high double, low double, close double, volume double").select(*CANDLE_COLUMNS)


def files_below(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_appends_and_leaves_base_files_as_they_were(spark, folder):
    insert_ignore(spark, candles(spark, (1, 1, 0, 1.0), (2, 1, 0, 1.0)), base_path(folder))
    before = files_below(base_path(folder))
    insert_ignore(spark, candles(spark, (1, 1, 0, 9.0), (1, 1, 1, 9.0), (3, 2, 0, 9.0)), staging_path(folder))
    assert sorted({p.day.day for p in merge_staged(spark, folder)}) == [1, 2]
    after = files_below(base_path(folder))
    assert all(after.get(f) == t for f, t in before.items()) and len(after) > len(before)
    got = {(r.asset_id, r.timestamp.minute): r.open for r in spark.read.parquet(base_path(folder)).where("asset_id < 3").collect()}
    assert got == {(1, 0): 1.0, (2, 0): 1.0, (1, 1): 9.0}
    assert stored_days(spark, staging_path(folder)) == []
    assert merge_staged(spark, folder) == []


def test_folders_that_are_no_days_are_passed_over(spark, folder):
    insert_ignore(spark, candles(spark, (1, 1, 0, 1.0)), base_path(folder))
    os.makedirs(f"{base_path(folder)}/day=+10000-01-01")
    assert len(stored_days(spark, base_path(folder))) == 1


def test_an_export_leaves_the_session_setting_as_it_was(spark, folder):
    key, before = "spark.sql.parquet.outputTimestampType", spark.conf.get("spark.sql.parquet.outputTimestampType")
    spark.conf.set(key, "INT96")
    try:
        export_parquet(candles(spark, (1, 1, 0, 1.0)), f"{folder}/out")
        assert spark.conf.get(key) == "INT96"
    finally:
        spark.conf.set(key, before)


def test_an_actor_without_any_time_has_no_age(spark):
    texts = ["{broken", '{"actor_name":"a","message_timestamp":1000}', '{"actor_name":"b"}']
    report = message_report(spark.createDataFrame([(t,) for t in texts], "value string"), datetime(1970, 1, 1, 0, 1, tzinfo=timezone.utc))
    assert {r.actor_name: (r.messages, r.oldest_age_seconds) for r in report.collect()} == {None: (1, None), "a": (1, 59.0), "b": (1, None)}
