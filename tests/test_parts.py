"""Stores cut by day and asset slot: what a write or refresh leaves alone, what survives another writer, ledgers, pages."""

from __future__ import annotations

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.helpers import assets, at, candle_rows, candles, minutes_of
from wickmill.functions.numbers import number, whole_number
from wickmill.operators.dedup import dedup_first
from wickmill.operators.rollup import all_tiers
from wickmill.plans.refresh import (
    base_path,
    merge_staged,
    note_touched,
    read_coverage,
    refresh_coverage,
    refresh_days,
    refresh_touched,
    staging_path,
    touched_path,
)
from wickmill.plans.repair import page_quarantine, refresh_ledger, repair_from_pages, repair_ledger
from wickmill.schemas import REFRESH_JOB, REPAIR_JOB
from wickmill.sources.klines import stream_messages
from wickmill.sources.ledgers import append_states, read_ledger, read_log
from wickmill.sources.pages import judge_pages, parse_pages, taken_pages
from wickmill.sources.tables import insert_ignore, read_candles, stored_days, take_files, write_candles
from wickmill.streaming.live import LiveTarget, compact_audit, read_audit
from wickmill.timeframes import ROLLUP_TIERS, tier_path

DAY = 24 * 60


@pytest.fixture()
def slots(spark):
    spark.conf.set("wickmill.asset.slots", "4")
    yield
    spark.conf.unset("wickmill.asset.slots")


def files_of(folder):
    return {p: (os.stat(p).st_mtime_ns, os.stat(p).st_ino) for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_a_late_candle_rewrites_its_own_part_only(spark, folder, slots):
    rows = [r for a in range(1, 9) for r in candle_rows(range(0, 3 * DAY, 30), asset_id=a)]
    write_candles(candles(spark, rows), base_path(folder))
    days = stored_days(spark, base_path(folder))
    refresh_days(spark, folder, days)
    refresh_coverage(spark, folder, days)
    before = files_of(folder)
    parts = insert_ignore(spark, candles(spark, candle_rows([DAY + 1], asset_id=6, price=900.0)), base_path(folder))
    note_touched(spark, folder, parts, "late")
    assert refresh_touched(spark, folder) == parts and [(p.day.day, p.slot) for p in parts] == [(2, 2)]
    after = files_of(folder)
    gone = [p for p in before if after.get(p) != before[p]]
    # Five tiers and the coverage of one part were replaced; no other file was touched.
    assert gone and all("day=2026-01-02/slot=2" in p and "tier=1m" not in p for p in gone)
    assert {p.split("/day=")[0].rsplit("/", 1)[1] for p in gone} == {*(f"tier={t}" for t in ROLLUP_TIERS), "coverage"}
    stored = read_candles(spark, base_path(folder))
    for tier in ROLLUP_TIERS:
        kept = read_candles(spark, tier_path(folder, tier))
        assert sorted(kept.collect()) == sorted(all_tiers(stored).where(F.col("tier") == tier).select(*kept.columns).collect())


def test_a_small_insert_reads_its_parts_only(spark, folder, slots):
    rows = [r for a in range(1, 9) for r in candle_rows(range(0, 2 * DAY, 30), asset_id=a)]
    write_candles(candles(spark, rows), folder)
    whole = len(read_candles(spark, folder).inputFiles())
    parts = insert_ignore(spark, candles(spark, candle_rows([31, 30], asset_id=3)), folder)
    touched = read_candles(spark, folder, parts=parts).inputFiles()
    assert len(parts) == 1 and 0 < len(touched) < whole / 4
    one = read_candles(spark, folder, asset_id=5)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_what_is_staged_during_a_merge_stays(spark, folder):
    insert_ignore(spark, candles(spark, candle_rows([0], price=100.0)), staging_path(folder))
    before = take_files(spark, read_candles(spark, staging_path(folder)))

    # Another writer stages a row of the same part after the merge has read it.
    import wickmill.plans.refresh as refresh

    plain = refresh.append_absent

    def slow(*args):
        plain(*args)
        write_candles(candles(spark, candle_rows([1], price=200.0)), staging_path(folder))

    refresh.append_absent = slow
    try:
        merge_staged(spark, folder)
    finally:
        refresh.append_absent = plain
    assert minutes_of(read_candles(spark, staging_path(folder)), "timestamp", "open") == [(1, 200.0)]
    assert not set(before) & set(take_files(spark, read_candles(spark, staging_path(folder))))
    assert len(merge_staged(spark, folder)) == 1
    assert minutes_of(read_candles(spark, base_path(folder)), "timestamp", "open") == [(0, 100.0), (1, 200.0)]
    assert stored_days(spark, staging_path(folder)) == []


def test_of_two_staged_copies_the_first_written_wins(spark, folder):
    for price in (300.0, 100.0, 200.0):
        write_candles(candles(spark, candle_rows([0], price=price)), staging_path(folder))
        for path in glob.glob(f"{staging_path(folder)}/**/*.parquet", recursive=True):
            if os.stat(path).st_mtime > 1_700_001_000:
                os.utime(path, (1_700_000_000 + price, 1_700_000_000 + price))
    merge_staged(spark, folder)
    assert minutes_of(read_candles(spark, base_path(folder)), "timestamp", "open") == [(0, 100.0)]


def test_notes_made_during_a_refresh_wait_for_the_next(spark, folder):
    parts = insert_ignore(spark, candles(spark, candle_rows([0])), base_path(folder))
    note_touched(spark, folder, parts, "batch-0")
    note_touched(spark, folder, parts, "batch-0")
    note_touched(spark, folder, parts, "batch-1")
    assert refresh_touched(spark, folder) == parts
    assert not glob.glob(f"{touched_path(folder)}/**/*.parquet", recursive=True)
    assert refresh_touched(spark, folder) == []
    assert minutes_of(read_coverage(spark, folder), "start_timestamp", "end_timestamp") == [(0, 0)]


def test_tied_copies_are_taken_whole(spark):
    rows = spark.createDataFrame([(1, at(0), 5.0, 1.0, ("p", 0)), (1, at(0), 1.0, 5.0, ("p", 0))], "asset_id int, timestamp timestamp, open double, close double, arrival struct<page: string, place: int>")
    got = dedup_first(rows, arrival="arrival").first()
    assert (got.open, got.close) in ((5.0, 1.0), (1.0, 5.0))


def test_numbers_as_text(spark):
    texts = ["1.5", "1.5d", "2f", " 7 ", "0x1p3", "1e2", "NaN", "", "abc", None, "5.0", "1706000040000.0", "-3", "1.7e12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(number(F.col("t"), F.lit(True)).alias("n"), whole_number(F.col("t"), F.lit(True)).alias("w")).collect()
    assert [r.n if r.n == r.n else "nan" for r in got] == [1.5, None, None, 7.0, None, 100.0, "nan", None, None, None, 5.0, 1706000040000.0, -3.0, 1.7e12]
    assert [r.w for r in got] == [1, None, None, 7, None, 100, None, None, None, None, 5, 1706000040000, -3, 1_700_000_000_000]


# -- ledgers -------------------------------------------------------------------------------------------------------


def job(status, retries=0, job_id=1):
    return (job_id, 1, "X", at(0), at(5), status, retries, 5, None, None, None, at(0))


def test_a_ledger_folds_to_the_latest_state_and_replays_add_nothing(spark, folder):
    def log(rows, run, minute=0):
        append_states(spark.createDataFrame(rows, REPAIR_JOB), REPAIR_JOB, folder, run, at(minute))

    assert read_ledger(spark, folder, REPAIR_JOB).count() == 0
    log([job("pending"), job("pending", job_id=2)], "a")
    log([job("processing")], "b")
    log([job("pending", 1)], "c")
    assert sorted((r.id, r.status, r.retry_count) for r in read_ledger(spark, folder, REPAIR_JOB).collect()) == [(1, "pending", 1), (2, "pending", 0)]
    log([job("processing", 1)], "d", 1)
    log([job("completed", 1)], "e", 1)
    for _ in range(2):
        log([job("pending"), job("pending", job_id=2)], "a", 9)
    assert sorted((r.id, r.status) for r in read_ledger(spark, folder, REPAIR_JOB).collect()) == [(1, "completed"), (2, "pending")]
    assert read_log(spark, folder, REPAIR_JOB).count() == 6


# -- pages ---------------------------------------------------------------------------------------------------------


def kline(minute, price=100.0, **cell):
    row = [int(at(minute).timestamp() * 1000), str(price), str(price + 5), str(price - 5), str(price + 1), "10"]
    for place, value in cell.items():
        row[int(place[1:])] = value
    return row


def page(name, minutes, asset=1, price=300.0, text=None, rows=None):
    rows = [kline(m, price) for m in minutes] if rows is None else rows
    return (name, asset, at(min(minutes)), at(max(minutes) + 1), json.dumps(rows) if text is None else text)


PAGES = "page_id string, asset_id int, page_start timestamp, page_end timestamp, value string"


def test_pages_are_taken_or_refused_whole(spark):
    given = [
        page("good", [0, 1, 2]), page("falls", [3, 4], rows=[kline(4), kline(3)]), page("twice", [5, 6], rows=[kline(5), kline(5)]),
        page("bad", [7, 8], rows=[kline(7), kline(8, c2="1")]), page("suffix", [9, 10], rows=[kline(9), kline(10, c1="100d")]),
        page("text", [11], text="{}"), page("short", [12, 13], rows=[kline(12), [1]]), page("later", [2, 14], price=900.0),
    ]
    parsed = parse_pages(spark.createDataFrame(given, PAGES).select("page_id", "value"))
    judged = judge_pages(parsed)
    assert {r.page_id: r.refused for r in judged.collect()} == {
        "good": None, "later": None, "falls": "disordered", "twice": "disordered", "bad": "high_below_low", "suffix": "missing_number",
        "text": "not_a_page", "short": "short_kline",
    }
    rows = dedup_first(taken_pages(parsed, judged).drop("page_id"), keys=["timestamp"])
    # Copies of a minute in two pages: the page that comes first wins, with all its values.
    assert minutes_of(rows, "timestamp", "open", "close") == [(0, 300, 301), (1, 300, 301), (2, 300, 301), (14, 900, 901)]


def test_repair_from_pages_keeps_its_ledger(spark, folder):
    held = list(range(11)) + list(range(21, 26)) + list(range(31, 36))
    as_of = at(35.5)
    write_candles(candles(spark, candle_rows(held)), base_path(folder))
    only = assets(spark).where("id = 1")
    good, bad = page("a", range(0, 26)), page("b", range(26, 36), rows=[kline(m) for m in (27, 26, 28)])
    pages = spark.createDataFrame([good, bad], PAGES)
    jobs = repair_from_pages(spark, folder, only, pages, as_of, "run-1")
    assert minutes_of(jobs.where("start_time >= '2026-01-01 10:00:00'"), "start_time", "status") == [(10, "completed"), (25, "failed")]
    stored = read_candles(spark, base_path(folder))
    assert minutes_of(stored.where("open = 300"), "timestamp") == [(m,) for m in range(11, 21)]
    assert minutes_of(read_coverage(spark, folder), "start_timestamp", "end_timestamp") == [(0, 25), (31, 35)]
    assert [(r.page_id, r.refused) for r in spark.read.parquet(page_quarantine(folder)).collect()] == [("b", "disordered")]
    # The same run again adds neither rows nor states.
    log = read_log(spark, repair_ledger(folder), REPAIR_JOB).count()
    repair_from_pages(spark, folder, only, pages, as_of, "run-1")
    assert read_candles(spark, base_path(folder)).count() == stored.count()
    assert read_ledger(spark, repair_ledger(folder), REPAIR_JOB).where("status in ('pending', 'processing')").count() == 0
    assert read_log(spark, repair_ledger(folder), REPAIR_JOB).count() <= log
    # A later run finds the rest of the gap, gets a sound page, and completes it.
    later = spark.createDataFrame([page("c", range(26, 36))], PAGES)
    repair_from_pages(spark, folder, only, later, at(35.9), "run-2")
    last = read_ledger(spark, repair_ledger(folder), REPAIR_JOB).where(F.col("start_time") == F.lit(at(25)))
    assert sorted((r.status, r.retry_count, r.error_category) for r in last.collect()) == [("completed", 0, None), ("failed", 1, "VALIDATION")]
    assert minutes_of(read_coverage(spark, folder), "start_timestamp", "end_timestamp") == [(0, 35)]
    assert {r.status for r in read_ledger(spark, refresh_ledger(folder), REFRESH_JOB).collect()} == {"completed"}


def test_pages_are_made_once_for_the_quarantine_and_not_for_the_ledger(spark, folder):
    """What makes the pages may be costly; refused ones are read back for the states of their jobs."""
    write_candles(candles(spark, candle_rows([0, 9])), base_path(folder))
    made = spark.sparkContext.accumulator(0)

    def seen(start):
        made.add(1)
        return start

    pages = spark.createDataFrame([page("a", range(0, 5)), page("b", range(5, 10), text="{}")], PAGES)
    counted = F.udf(seen, "timestamp").asNondeterministic()
    jobs = repair_from_pages(spark, folder, assets(spark).where("id = 1"), pages.withColumn("page_start", counted("page_start")), at(9.5), "run-1")
    failed = jobs.where("status = 'failed'").collect()
    assert [r.error_message for r in failed] == ["PayloadCorruptionError: not_a_page"]
    assert made.value <= 2


def test_a_run_that_died_is_taken_over_after_its_lease(spark, folder):
    write_candles(candles(spark, candle_rows([0, 9])), base_path(folder))
    row = (5, 1, "BTCUSDT", at(0), at(9), "processing", 0, 5, None, None, at(10), at(9))
    append_states(spark.createDataFrame([row], REPAIR_JOB), REPAIR_JOB, repair_ledger(folder), "dead", at(9))
    pages = spark.createDataFrame([page("a", range(0, 10))], PAGES)
    only = assets(spark).where("id = 1")
    repair_from_pages(spark, folder, only, pages, at(9.5), "early")
    assert read_candles(spark, base_path(folder)).count() == 2
    repair_from_pages(spark, folder, only, pages, at(12), "late")
    assert read_candles(spark, base_path(folder)).count() == 10
    taken = read_ledger(spark, repair_ledger(folder), REPAIR_JOB).where("id = 5").first()
    assert taken.status == "completed"


# -- streams -------------------------------------------------------------------------------------------------------


def test_a_backlog_is_worked_off_in_bounded_batches(spark, folder):
    os.makedirs(f"{folder}/in")
    for k in range(12):
        with open(f"{folder}/in/small-{k:02d}.txt", "w") as f:
            f.write("x" * 1000 + "\n")
    with open(f"{folder}/in/large.txt", "w") as f:
        f.write(("y" * 999 + "\n") * 20)
    sizes = []
    stream = stream_messages(spark, f"{folder}/in", bytes_per_trigger=5000)
    done = (
        stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count()))
        .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    )
    done.awaitTermination()
    assert sum(sizes) == 32 and max(sizes) <= 20 + 5 and len(sizes) >= 3


def test_counters_of_a_past_day_are_compacted(spark, folder):
    from tests.test_streaming import land, message, run

    os.makedirs(f"{folder}/in")
    target = LiveTarget(f"{folder}/tables", f"{folder}/assets")
    assets(spark).write.parquet(target.assets_path)
    for k in range(3):
        land(f"{folder}/in", f"f{k}", [message("BTCUSDT", k, 100), message("BTCUSDT", k, 101), "{"])
    run(spark, folder, target, at(30))
    before = sorted(map(tuple, read_audit(spark, target).collect()))
    assert [r[1:] for r in before] == [(k, 1, 2, 1, 0, 0, 1, 1) for k in range(3)]
    compact_audit(spark, target, at(30).date())
    assert sorted(map(tuple, read_audit(spark, target).collect())) == before
    assert len(glob.glob(f"{target.audit}/day=*/part=*/*.parquet")) == 1
