"""Stored tables: layout, pruning, first-write-wins, merge, refresh, exports."""

from __future__ import annotations

import glob
import json

import pyarrow.parquet as pq
import pytest

from tests.helpers import BASE, assets, at, candle_rows, candles, minutes_of
from wickmill.operators import coverage as C
from wickmill.operators.ledger import refresh_jobs, schedule_repairs
from wickmill.plans.reads import AssetNotFound
from wickmill.plans.reads import candles as read_tier
from wickmill.plans.refresh import (
    base_path,
    merge_staged,
    read_coverage,
    refresh_coverage,
    refresh_days,
    refresh_windows,
    staging_path,
)
from wickmill.plans.repair import finished_minute, repair_gaps, scan_gaps, with_missing
from wickmill.schemas import REPAIR_JOB
from wickmill.session import scratch_dir
from wickmill.sources.outputs import export_parquet, export_requests, write_ndjson, write_quarantine
from wickmill.sources.tables import insert_ignore, read_candles, stored_days, write_candles
from wickmill.timeframes import tier_path

DAY = 24 * 60


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_prune_days_and_push_filters(spark, folder):
    rows = [r for a in range(1, 6) for r in candle_rows(range(0, 5 * DAY, 7), asset_id=a)]
    write_candles(candles(spark, rows), folder)
    assert len(stored_days(spark, folder)) == 6
    df = read_candles(spark, folder, at(DAY), at(2 * DAY), asset_id=3)
    plan = plan_of(df)
    partition = plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "day" in partition and "EqualTo(asset_id,3)" in pushed and "GreaterThanOrEqual(timestamp" in pushed
    expected = [m for m in range(0, 5 * DAY, 7) if DAY <= m < 2 * DAY]
    assert minutes_of(df, "timestamp") == [(m,) for m in expected]
    one = read_candles(spark, folder, asset_id=3).select("close")
    assert "ReadSchema: struct<asset_id:int,close:double>" in plan_of(one)


def test_rows_lie_by_asset_newest_first(spark, folder):
    write_candles(candles(spark, [r for a in (3, 1) for r in candle_rows(range(30), asset_id=a)]), folder)
    seen = []
    for path in sorted(glob.glob(f"{folder}/day=*/slot=*/*.parquet")):
        table = pq.read_table(path, columns=["asset_id", "timestamp"], partitioning=None)
        seen += list(zip(table["asset_id"].to_pylist(), table["timestamp"].to_pylist()))
    assert len(seen) == 60
    assert seen == sorted(seen, key=lambda r: (r[0], -r[1].timestamp()))


def test_first_write_wins_and_replay_adds_nothing(spark, folder):
    first = candles(spark, candle_rows([0, 1], price=100.0))
    later = candles(spark, candle_rows([1, 2], price=200.0))
    for _ in range(2):
        insert_ignore(spark, first, folder)
        insert_ignore(spark, later, folder)
    assert minutes_of(read_candles(spark, folder), "timestamp", "open") == [(0, 100.0), (1, 100.0), (2, 200.0)]


def test_overlapping_jobs_leave_one_range(spark, folder):
    insert_ignore(spark, candles(spark, candle_rows(range(61))), folder)
    insert_ignore(spark, candles(spark, candle_rows(range(30, 91))), folder)
    stored = read_candles(spark, folder)
    assert stored.count() == 91
    assert minutes_of(C.coverage_ranges(stored), "start_timestamp", "end_timestamp") == [(0, 90)]


def test_merge_moves_staged_days(spark, folder):
    insert_ignore(spark, candles(spark, candle_rows([0, DAY], price=100.0)), base_path(folder))
    insert_ignore(spark, candles(spark, candle_rows([0, 1, 2 * DAY], price=200.0)), staging_path(folder))
    parts = merge_staged(spark, folder)
    assert [p.day.day for p in parts] == [1, 3]
    got = minutes_of(read_candles(spark, base_path(folder)), "timestamp", "open")
    assert got == [(0, 100.0), (1, 200.0), (DAY, 100.0), (2 * DAY, 200.0)]
    assert stored_days(spark, staging_path(folder)) == []
    assert merge_staged(spark, folder) == []


def test_refresh_touches_only_its_days(spark, folder):
    write_candles(candles(spark, candle_rows(range(0, 3 * DAY, 60))), base_path(folder))
    refresh_days(spark, folder, stored_days(spark, base_path(folder)))
    untouched = set(glob.glob(f"{folder}/tier=1h/day=2026-01-01/slot=*/*.parquet"))
    insert_ignore(spark, candles(spark, candle_rows([DAY + 1], price=900.0)), base_path(folder))
    windows = spark.createDataFrame([(at(DAY), at(DAY + 2)), (at(DAY), at(DAY + 3))], "start_time timestamp, end_time timestamp")
    days = refresh_windows(spark, folder, refresh_jobs(windows, BASE))
    assert [d.day for d in days] == [2]
    assert set(glob.glob(f"{folder}/tier=1h/day=2026-01-01/slot=*/*.parquet")) == untouched
    high = read_candles(spark, tier_path(folder, "1d")).where("high > 900").count()
    assert high == 1


def test_a_day_that_lost_its_rows_loses_its_tiers(spark, folder):
    write_candles(candles(spark, candle_rows([0, DAY])), base_path(folder))
    days = stored_days(spark, base_path(folder))
    refresh_days(spark, folder, days)
    from wickmill.sources.tables import drop_days

    drop_days(spark, base_path(folder), days[:1])
    refresh_days(spark, folder, days)
    assert minutes_of(read_candles(spark, tier_path(folder, "5m")), "timestamp") == [(DAY,)]


def test_coverage_is_kept_by_day_and_joined_on_read(spark, folder):
    insert_ignore(spark, candles(spark, candle_rows([13 * 60 + 59, 14 * 60 + 1])), base_path(folder))
    refresh_coverage(spark, folder, stored_days(spark, base_path(folder)))
    assert read_coverage(spark, folder).count() == 2
    refresh_coverage(spark, folder, insert_ignore(spark, candles(spark, candle_rows([14 * 60])), base_path(folder)))
    got = minutes_of(read_coverage(spark, folder, asset_id=1), "start_timestamp", "end_timestamp")
    assert got == [(13 * 60 + 59, 14 * 60 + 1)]


def test_tier_read_checks_asset(spark, folder):
    write_candles(candles(spark, candle_rows(range(20))), base_path(folder))
    refresh_days(spark, folder, stored_days(spark, base_path(folder)))
    df = read_tier(spark, folder, 1, "5m", at(5), at(15), assets(spark))
    assert df.columns == ["timestamp", "open", "high", "low", "close", "volume"]
    assert minutes_of(df, "timestamp", "volume") == [(5, 50.0), (10, 50.0)]
    with pytest.raises(AssetNotFound):
        read_tier(spark, folder, 99, "5m", at(5), at(15), assets(spark))


def test_outage_is_repaired(spark, folder):
    """Eleven candles, ten missing, five more: one gap, 26 candles and one range afterwards."""
    held = list(range(11)) + list(range(21, 26))
    as_of = at(25.5)
    write_candles(candles(spark, candle_rows(held)), base_path(folder))
    only = assets(spark).where("id = 1")
    ledger = spark.createDataFrame([], REPAIR_JOB)
    gaps = scan_gaps(read_candles(spark, base_path(folder)), only, as_of)
    assert minutes_of(gaps, "start_time", "end_time") == [(25 - DAY, 0), (10, 21)]
    assert sorted(r.missing for r in with_missing(gaps).collect()) == [10, DAY - 25 - 1]
    pages = candles(spark, candle_rows(range(26), price=300.0)).selectExpr("*", "unix_seconds(timestamp) AS arrival_seq")
    repair_gaps(spark, folder, only, ledger, pages, as_of)
    stored = read_candles(spark, base_path(folder))
    assert stored.count() == 26
    assert minutes_of(C.coverage_ranges(stored), "start_timestamp", "end_timestamp") == [(0, 25)]
    assert minutes_of(stored.where("open = 300"), "timestamp") == [(m,) for m in range(11, 21)]
    assert minutes_of(read_coverage(spark, folder), "start_timestamp", "end_timestamp") == [(0, 25)]
    again = repair_gaps(spark, folder, only, ledger, pages, as_of)
    assert read_candles(spark, base_path(folder)).count() == 26 and again.staged == []


def test_an_active_job_keeps_its_window(spark):
    gaps = spark.createDataFrame([(1, "btcusdt", at(0), at(5)), (1, "btcusdt", at(9), at(12)), (1, "btcusdt", at(3), at(3))], "asset_id int, symbol string, start_time timestamp, end_time timestamp")
    row = (7, 1, "BTCUSDT", at(0), at(5), "processing", 0, 5, None, None, None, BASE)
    ledger = spark.createDataFrame([row], REPAIR_JOB)
    got = schedule_repairs(gaps, ledger, BASE).collect()
    assert [(r.symbol, r.status, r.retry_count) for r in got] == [("BTCUSDT", "pending", 0)]
    assert finished_minute(at(1.5)) == at(1)


def test_export_file_format(spark, folder):
    export_parquet(candles(spark, candle_rows([2, 0, 1])), f"{folder}/one")
    (path,) = [p for p in glob.glob(f"{folder}/one/*.parquet")]
    meta = pq.ParquetFile(path)
    assert [str(f.type) for f in meta.schema_arrow] == ["timestamp[ms, tz=UTC]"] + ["double"] * 5
    assert meta.metadata.row_group(0).column(0).compression == "GZIP"
    assert spark.conf.get("spark.sql.parquet.outputTimestampType") == "TIMESTAMP_MICROS"


def test_many_exports_in_one_run(spark, folder):
    rows = [("a", 1, "1m", at(0), at(2)), ("b", 1, "1m", at(1), at(3)), ("c", 2, "1m", at(0), at(9)), ("d", 1, "5m", at(0), at(9))]
    jobs = spark.createDataFrame(rows, "job_id string, asset_id int, timeframe string, start_time timestamp, end_time timestamp")
    export_requests(candles(spark, candle_rows(range(4)) + candle_rows([5], asset_id=2)), jobs, folder, "1m")
    found = sorted(p[len(folder) + 1 :].rsplit("/", 1)[0] for p in glob.glob(f"{folder}/exports/*/*/*/*.parquet"))
    assert sorted(set(found)) == [f"exports/asset_id={a}/timeframe=1m/job_id={j}" for a, j in ((1, "a"), (1, "b"), (2, "c"))]
    assert spark.read.parquet(f"{folder}/exports").groupBy("job_id").count().where("job_id = 'a'").first()[1] == 2


def test_ndjson_lines(spark, folder):
    write_ndjson(candles(spark, candle_rows([1, 0])), f"{folder}/lines")
    lines = [json.loads(line) for p in sorted(glob.glob(f"{folder}/lines/*.txt")) for line in open(p)]
    assert [x["timestamp"] for x in lines] == ["2026-01-01T10:00:00+00:00", "2026-01-01T10:01:00+00:00"]
    assert list(lines[0]) == ["timestamp", "open", "high", "low", "close", "volume"] and lines[0]["close"] == 101.0


def test_quarantine_keeps_reasons(spark, folder):
    write_quarantine(spark.createDataFrame([("x", "not_a_kline")], "value string, reject_reason string"), f"{folder}/q", BASE)
    row = spark.read.parquet(f"{folder}/q").first()
    assert (row.value, row.reject_reason, str(row.refused_on)) == ("x", "not_a_kline", "2026-01-01")


def test_scratch_follows_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(shared) and scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_exports_are_dealt_by_number_and_replaced_when_run_again(spark, folder):
    """Many small exports are the work of many tasks; a request that is exported again is replaced, others stay."""
    rows = [row for asset in range(40) for row in candle_rows(range(3), asset_id=asset)]
    jobs = spark.createDataFrame(
        [(f"j{a}", a, "1m", at(0), at(9)) for a in range(40)], "job_id string, asset_id int, timeframe string, start_time timestamp, end_time timestamp"
    )
    export_requests(candles(spark, rows), jobs, folder, "1m")
    files = glob.glob(f"{folder}/exports/*/*/*/*.parquet")
    assert len(files) == 40
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) > 20
    export_requests(candles(spark, candle_rows(range(2), asset_id=7)), jobs, folder, "1m")
    counts = {r.job_id: r["count"] for r in spark.read.parquet(f"{folder}/exports").groupBy("job_id").count().collect()}
    assert counts == {**{f"j{a}": 3 for a in range(40)}, "j7": 2}
