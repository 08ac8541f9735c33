"""The stateful rollup: redelivered, evicted and very late candles, open buckets, compaction of the log."""

from __future__ import annotations

import glob
from datetime import timedelta

from tests.helpers import at, candle_rows, candles, minutes_of
from wickmill.operators.rollup import rollup
from wickmill.schemas import CANDLE, OHLCV
from wickmill.sources.tables import stored_days
from wickmill.streaming.rollup import compact_tier_log, read_late, read_tier_log, settle_late, start_tier_log, stream_rollup

DELAY = timedelta(minutes=30)
SCHEMA = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in CANDLE)}, arrived_at timestamp, arrival_seq long"


class Feed:
    """Candles landed batch by batch, each row with the minute it arrives."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.count = spark, folder, 0

    def land(self, *rows):
        out = []
        for minute, arrives in rows:
            (row,) = candle_rows([minute], price=100.0 + minute % 50)
            self.count += 1
            out.append((*row, at(arrives), self.count))
        self.spark.createDataFrame(out, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.folder}/in")
        rolled = stream_rollup(stream, "1h", delay=DELAY)
        start_tier_log(rolled, f"{self.folder}/log", f"{self.folder}/ck", available_now=True).awaitTermination()

    def buckets(self):
        return minutes_of(read_tier_log(self.spark, f"{self.folder}/log"), "timestamp", *OHLCV)


def wanted(spark, minutes):
    return minutes_of(rollup(candles(spark, [r for m in minutes for r in candle_rows([m], price=100.0 + m % 50)]), "1h"), "timestamp", *OHLCV)


def test_every_candle_counts_once_whenever_it_comes(spark, folder):
    feed = Feed(spark, folder)
    feed.land((0, 1), (1, 2), (1, 2), (2, 3))
    feed.land((1, 9), (2, 20), (10, 11), (61, 62))
    # Two candles come too late, one of them twice; one that the state has forgotten comes again.
    feed.land((3, 200), (4, 200), (4, 201), (0, 220), (199, 221))
    feed.land((4, 300), (200, 222))
    feed.land((310, 311))
    on_time = [0, 1, 2, 10, 61, 199, 200, 310]
    assert feed.buckets() == wanted(spark, on_time)
    assert sum(r["rows"] for r in read_late(spark, f"{folder}/log").collect()) == 5
    base = candles(spark, [r for m in [*on_time, 3, 4] for r in candle_rows([m], price=100.0 + m % 50)])
    # The first hour is not closed yet: the notes wait.
    settle_late(spark, f"{folder}/log", base, "1h", DELAY, at(80))
    assert feed.buckets() == wanted(spark, on_time)
    assert sum(r["rows"] for r in read_late(spark, f"{folder}/log").collect()) == 5
    settle_late(spark, f"{folder}/log", base, "1h", DELAY, at(320))
    assert feed.buckets() == wanted(spark, [*on_time, 3, 4])
    assert read_late(spark, f"{folder}/log").count() == 0
    for _ in range(2):
        for day in stored_days(spark, f"{folder}/log"):
            compact_tier_log(spark, f"{folder}/log", day)
        assert feed.buckets() == wanted(spark, [*on_time, 3, 4])
    parts = {p.split("/part=")[1].split("/")[0] for p in glob.glob(f"{folder}/log/day=*/part=*/*.parquet")}
    assert parts == {"folded"}
    # What comes after the compaction counts on top, in an open bucket as in a new one.
    feed.land((311, 312), (400, 401))
    assert feed.buckets() == wanted(spark, [*on_time, 3, 4, 311, 400])
    settle_late(spark, f"{folder}/log", base, "1h", DELAY, at(9000))
    assert feed.buckets() == wanted(spark, [*on_time, 3, 4, 311, 400])


def test_state_is_dropped_after_the_delay(spark, folder):
    feed = Feed(spark, folder)
    feed.land(*((m, m + 1) for m in range(0, 40)))
    feed.land((500, 501))
    feed.land((501, 502))
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    query = start_tier_log(stream_rollup(stream, "1h", delay=DELAY), f"{folder}/log", f"{folder}/ck", available_now=True)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert not held or held[-1] <= 2
    assert feed.buckets() == wanted(spark, [*range(40), 500, 501])
