"""Streaming jobs against their batch forms: shuffled arrival, copies, replay, late rows."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import connect, differences
from tests.helpers import BASE, assets, at, candle_rows, candles, minutes_of
from wickmill.catalog import streams
from wickmill.operators import coverage as C
from wickmill.operators.rollup import rollup
from wickmill.plans.refresh import base_path, read_coverage, refresh_touched, staging_path
from wickmill.schemas import CANDLE, OHLCV
from wickmill.session import configure
from wickmill.sources.klines import BYTES_PER_TRIGGER, stream_messages
from wickmill.sources.tables import read_candles
from wickmill.streaming.live import LiveTarget, read_audit, start_live_ingest
from wickmill.streaming.rollup import read_tier_log, start_tier_log, stream_rollup
from wickmill.timeframes import tier_path

DAY = 24 * 60


def message(symbol, minute, price, **changes):
    ms = int(at(minute).timestamp() * 1000)
    k = {"t": ms, "T": ms + 59999, "s": symbol, "i": "1m", "o": str(price), "h": str(price + 5), "l": str(price - 5),
         "c": str(price + 1), "v": "2", "x": True, **changes}
    return json.dumps({"e": "kline", "E": ms, "s": symbol, "k": k})


def land(folder, name, lines):
    with open(f"{folder}/{name}.txt", "w") as f:
        f.write("\n".join(lines) + "\n")


def target_of(spark, folder):
    target = LiveTarget(f"{folder}/tables", f"{folder}/assets")
    assets(spark).write.mode("overwrite").parquet(target.assets_path)
    return target


def test_no_method_is_too_long_to_be_compiled(spark):
    """A micro-batch session, too, leaves steps whose method the Java machine would only interpret to their operators."""
    for session in (spark, configure(spark.newSession())):
        assert int(session.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def run(spark, folder, target, as_of, checkpoint="checkpoint", files=1):
    stream = stream_messages(spark, f"{folder}/in", files_per_trigger=files)
    start_live_ingest(stream, target, f"{folder}/{checkpoint}", clock=lambda: as_of, available_now=True).awaitTermination()
    refresh_touched(spark, target.root)


def test_live_ingest(spark, folder):
    import os

    os.makedirs(f"{folder}/in")
    target, as_of = target_of(spark, folder), at(30)
    land(f"{folder}/in", "a", [message("BTCUSDT", m, 100 + m) for m in (0, 2, 3)] + [message("ETHUSDT", 0, 50), '{"result":null,"id":1}', "{broken"])
    run(spark, folder, target, as_of)
    assert minutes_of(read_coverage(spark, target.root), "asset_id", "start_timestamp", "end_timestamp") == [(1, 0, 0), (1, 2, 3), (2, 0, 0)]
    # A copy with other values, the missing minute, an unknown and an inactive symbol, an unfinished candle,
    # and a candle from before the live horizon.
    land(f"{folder}/in", "b", [message("BTCUSDT", 2, 900), message(" btcusdt ", 1, 101), message("BTCUSDT", 1, 700),
                               message("NOPE", 1, 10), message("DELISTEDUSDT", 1, 10), message("BTCUSDT", 9, 100, x=False),
                               message("BTCUSDT", -10 * DAY, 77)])
    run(spark, folder, target, as_of)
    stored = read_candles(spark, base_path(target.root))
    assert minutes_of(stored.where("asset_id = 1"), "timestamp", "open") == [(-10 * DAY, 77), (0, 100), (1, 101), (2, 102), (3, 103)]
    assert read_candles(spark, staging_path(target.root)).count() == 0
    got = minutes_of(read_coverage(spark, target.root, 1), "start_timestamp", "end_timestamp")
    assert got == [(-10 * DAY, -10 * DAY), (0, 3)]
    tiers = read_candles(spark, tier_path(target.root, "5m")).where("asset_id = 1")
    assert minutes_of(tiers, "timestamp", "open", "close", "volume") == [(-10 * DAY, 77, 78, 2), (0, 100, 104, 8)]
    audit = {r.batch_id: r for r in read_audit(spark, target).collect()}
    assert audit[0].persisted == 4 and audit[0].rejected == 1 and audit[0].batches == 1
    second = audit[1]
    assert (second.received, second.rejected, second.unmapped, second.inactive, second.duplicate, second.persisted) == (6, 1, 1, 1, 1, 3)
    reasons = sorted(r.outcome for r in spark.read.parquet(target.quarantine).collect())
    assert reasons == ["inactive", "not_a_kline", "rejected:not_closed", "unmapped"]
    # Everything delivered again, from an empty checkpoint: not one row more.
    before = sorted(read_candles(spark, base_path(target.root)).collect())
    run(spark, folder, target, as_of, checkpoint="again", files=10)
    assert sorted(read_candles(spark, base_path(target.root)).collect()) == before
    # A newly activated asset is picked up by the next batch.
    assets(spark).withColumn("is_active", F.lit(True)).write.mode("overwrite").parquet(target.assets_path)
    land(f"{folder}/in", "c", [message("DELISTEDUSDT", 5, 10)])
    run(spark, folder, target, as_of)
    assert minutes_of(read_candles(spark, base_path(target.root)).where("asset_id = 4"), "timestamp") == [(5,)]


def test_first_landed_file_wins_over_a_larger_later_one(spark, folder):
    import os

    os.makedirs(f"{folder}/in")
    target = target_of(spark, folder)
    land(f"{folder}/in", "z", [message("BTCUSDT", 0, 100)])
    land(f"{folder}/in", "a", [message("BTCUSDT", m, 900 + m) for m in range(500)])
    for name, seconds in (("z", 1_700_000_000), ("a", 1_700_000_060)):
        os.utime(f"{folder}/in/{name}.txt", (seconds, seconds))
    run(spark, folder, target, at(600), files=10)
    stored = read_candles(spark, base_path(target.root))
    assert stored.count() == 500
    assert minutes_of(stored.where("open < 900"), "timestamp", "open", "close", "high") == [(0, 100, 101, 105)]


def test_shuffled_arrival_equals_batch(spark, folder):
    import os

    os.makedirs(f"{folder}/in")
    target = target_of(spark, folder)
    rng = random.Random(3)
    keys = [(s, m) for s in ("BTCUSDT", "ETHUSDT") for m in range(60) if m % 17]
    lines = [message(s, m, 100 + m) for s, m in keys + rng.sample(keys, 40)]
    rng.shuffle(lines)
    for i in range(3):
        land(f"{folder}/in", f"f{i}", lines[i::3])
    run(spark, folder, target, at(90))
    stored = read_candles(spark, base_path(target.root))
    ids = {"BTCUSDT": 1, "ETHUSDT": 2}
    assert minutes_of(stored, "asset_id", "timestamp", "open") == sorted((ids[s], m, 100 + m) for s, m in keys)
    ranges = ["asset_id", "start_timestamp", "end_timestamp"]
    assert minutes_of(read_coverage(spark, target.root), *ranges) == minutes_of(C.coverage_ranges(stored), *ranges)
    for tier in ("5m", "1h", "1d"):
        kept = read_candles(spark, tier_path(target.root, tier))
        assert sorted(kept.collect()) == sorted(rollup(stored, tier).select(*kept.columns).collect())


def test_stream_rollup_over_several_batches(spark, folder):
    rows = [r for a in (1, 2) for r in candle_rows(range(0, 300, 3), asset_id=a)]
    random.Random(5).shuffle(rows)
    for i in range(4):
        candles(spark, rows[i::4]).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(CANDLE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start_tier_log(stream_rollup(stream, "1h"), f"{folder}/log", f"{folder}/ck", available_now=True).awaitTermination()
    got = read_tier_log(spark, f"{folder}/log").select("asset_id", "timestamp", *OHLCV)
    expected = rollup(candles(spark, rows), "1h").select(*got.columns)
    assert sorted(got.collect()) == sorted(expected.collect())
    assert spark.read.parquet(f"{folder}/log").select("batch_id").distinct().count() == 4


def test_stream_rollup_keeps_candles_of_any_lateness(spark, folder):
    parts = [candle_rows([0, 1]), candle_rows([60 * DAY, 60 * DAY + 1]), candle_rows([2, 3])]
    for rows in parts:
        candles(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(CANDLE).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start_tier_log(stream_rollup(stream, "1h"), f"{folder}/log", f"{folder}/ck", available_now=True).awaitTermination()
    got = read_tier_log(spark, f"{folder}/log").select("asset_id", "timestamp", *OHLCV)
    expected = rollup(candles(spark, sum(parts, [])), "1h").select(*got.columns)
    assert got.count() == 2 and sorted(got.collect()) == sorted(expected.collect())


def test_audit_counts_by_landing_however_large_it_is(spark, monkeypatch):
    """A landing beyond the bound on a micro-batch's bytes is still one batch of the audit."""
    small = "/root/testdata/sf0.001"

    def tiny(session, path, files_per_trigger=None, bytes_per_trigger=BYTES_PER_TRIGGER):
        return stream_messages(session, path, files_per_trigger, bytes_per_trigger and 1000)

    monkeypatch.setattr(streams, "stream_messages", tiny)
    # Each landing has several files.
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "100")
    try:
        got = entry.queries()["stream_audit"](spark, small).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert differences(got, connect(small).execute(entry.oracle_sql()["stream_audit"]).df()) is None


def test_base_is_the_test_epoch():
    assert BASE.tzinfo is not None
