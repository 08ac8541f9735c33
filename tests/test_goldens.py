"""Hand-written cases with known answers."""

from __future__ import annotations

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, assets, at, candle_rows, candles, minutes_of, naive, ranges, requests
from wickmill.functions.checks import candle_reject_reason
from wickmill.functions.time import align_end, align_start
from wickmill.operators import coverage as C
from wickmill.operators.dedup import dedup_first
from wickmill.operators.ingest import classify_events, ingest_audit, ordered_pages
from wickmill.operators.rollup import rollup, rollup_cascade
from wickmill.operators.series import sustained_alerts
from wickmill.operators.shards import shard_sizes, symbols_of_shard, with_shard
from wickmill.plans.backfill import page_plan
from wickmill.sources.klines import final_events, good_events, parse_klines
from wickmill.sources.pages import good_klines, parse_pages, read_pages
from wickmill.timeframes import InvalidDateRange, UnsupportedTimeframe, check_window


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def test_five_minutes_roll_up(spark):
    rows = [
        (1, at(0), 100.0, 105.0, 99.5, 102.0, 10.0),
        (1, at(1), 102.0, 110.0, 101.0, 104.0, 0.0),
        (1, at(2), 104.0, 106.0, 100.0, 105.0, 0.0),
        (1, at(3), 105.0, 107.0, 99.0, 106.0, 0.0),
        (1, at(4), 106.0, 108.5, 105.0, 108.0, 20.0),
    ]
    (row,) = rollup(candles(spark, rows), "5m").collect()
    assert tuple(row) == (1, naive(BASE), 100.0, 110.0, 99.0, 108.0, 30.0)


@pytest.mark.parametrize(
    "covered, asked, expected",
    [
        ([(0, 2), (4, 10)], (0, 10), [(2, 4)]),
        ([(0, 60), (120, 180), (240, 300)], (0, 300), [(60, 120), (180, 240)]),
        ([(10, 20)], (0, 30), [(0, 10), (20, 30)]),
        ([], (0, 10), [(0, 10)]),
        ([(0, 10), (11, 20), (5, 15), (30, 40)], (0, 40), [(20, 30)]),
        ([(0, 10)], (10, 20), [(10, 20)]),
        ([(0, 30)], (10, 20), []),
        ([(0, 5)], (20, 30), [(20, 30)]),
        ([(40, 50)], (20, 30), [(20, 30)]),
        ([(0, 3000)], (-60, 4000), [(-60, 0), (3000, 4000)]),
    ],
)
def test_gaps(spark, covered, asked, expected):
    held = ranges(spark, [(1, s, e) for s, e in covered])
    got = C.coverage_gaps(held, requests(spark, [(1, *asked)]))
    assert minutes_of(got, "gap_start", "gap_end") == expected


def test_touching_ranges_merge(spark):
    given = ranges(spark, [(1, 0, 10), (1, 11, 20), (1, 5, 15), (1, 30, 40), (2, 0, 1)])
    got = C.merge_ranges(given)
    assert minutes_of(got, "asset_id", "start_timestamp", "end_timestamp") == [(1, 0, 20), (1, 30, 40), (2, 0, 1)]


def test_a_hole_splits_blocks(spark):
    got = C.contiguous_blocks(candles(spark, candle_rows([0, 1, 3, 4])))
    assert minutes_of(got, "start_timestamp", "end_timestamp", "candles") == [(0, 1, 2), (3, 4, 2)]


def test_steps_below_a_minute_split_blocks_but_not_coverage(spark):
    rows = candles(spark, candle_rows([0, 0.5, 1.5]))
    assert minutes_of(C.contiguous_blocks(rows), "start_timestamp", "end_timestamp") == [(0, 0), (0.5, 1.5)]
    assert minutes_of(C.coverage_ranges(rows), "start_timestamp", "end_timestamp") == [(0, 1.5)]


def test_blocks_cross_midnight(spark):
    late = list(range(14 * 60 - 3, 14 * 60 + 3))
    got = C.contiguous_blocks(candles(spark, candle_rows(late)))
    assert minutes_of(got, "start_timestamp", "end_timestamp", "candles") == [(late[0], late[-1], 6)]


def test_disordered_page_is_refused(spark):
    rows = [("good", 0, at(0)), ("good", 1, at(1)), ("bad", 0, at(1)), ("bad", 1, at(0)), ("twice", 0, at(0)), ("twice", 1, at(0))]
    df = spark.createDataFrame(rows, "batch_id string, arrival_seq long, timestamp timestamp")
    assert {r.batch_id for r in ordered_pages(df).collect()} == {"good"}


def test_late_candle_joins_two_ranges(spark):
    first = candles(spark, candle_rows([0, 2]))
    assert C.coverage_ranges(first).count() == 2
    joined = first.unionByName(candles(spark, candle_rows([1])))
    assert minutes_of(C.coverage_ranges(joined), "start_timestamp", "end_timestamp") == [(0, 2)]


@pytest.mark.parametrize(
    "start, end, tier, expected",
    [
        (utc(2026, 1, 1, 10, 1), utc(2026, 1, 1, 10, 7), "5m", (utc(2026, 1, 1, 10), utc(2026, 1, 1, 10, 10))),
        (utc(2026, 1, 1, 10, 1), utc(2026, 1, 1, 10, 7), "15m", (utc(2026, 1, 1, 10), utc(2026, 1, 1, 10, 15))),
        (utc(2026, 1, 1, 10, 1), utc(2026, 1, 1, 10, 7), "1h", (utc(2026, 1, 1, 10), utc(2026, 1, 1, 11))),
        (utc(2026, 1, 1, 10, 1), utc(2026, 1, 1, 10, 7), "4h", (utc(2026, 1, 1, 8), utc(2026, 1, 1, 12))),
        (utc(2026, 1, 1, 10, 1), utc(2026, 1, 1, 10, 7), None, (utc(2026, 1, 1), utc(2026, 1, 2))),
        (utc(2026, 1, 1, 10, 7), utc(2026, 1, 1, 10, 22), "15m", (utc(2026, 1, 1, 10), utc(2026, 1, 1, 10, 30))),
        (utc(2026, 1, 1, 10, 15), utc(2026, 1, 1, 11, 5), "1h", (utc(2026, 1, 1, 10), utc(2026, 1, 1, 12))),
        (utc(2026, 1, 1, 2, 30), utc(2026, 1, 1, 5, 15), "4h", (utc(2026, 1, 1), utc(2026, 1, 1, 8))),
        (utc(2026, 1, 1, 15), utc(2026, 1, 2, 8), "1d", (utc(2026, 1, 1), utc(2026, 1, 3))),
        (utc(2026, 1, 1, 10), utc(2026, 1, 1, 10, 5), "5m", (utc(2026, 1, 1, 10), utc(2026, 1, 1, 10, 5))),
    ],
)
def test_alignment(spark, start, end, tier, expected):
    df = spark.createDataFrame([(start, end)], "s timestamp, e timestamp")
    row = df.select(align_start("s", tier), align_end("e", tier)).first()
    assert tuple(row) == tuple(naive(x) for x in expected)


def test_span_limits():
    with pytest.raises(InvalidDateRange, match="30 days"):
        check_window("1m", utc(2023, 1, 1), utc(2023, 2, 2), mode="service")
    check_window("1m", utc(2023, 1, 1), utc(2023, 1, 31, 23), mode="service")
    check_window("1m", utc(2023, 1, 1), utc(2024, 1, 1), mode="export")
    check_window("1d", utc(1990, 1, 1), utc(2024, 1, 1), mode="service")
    with pytest.raises(InvalidDateRange):
        check_window("1d", utc(2023, 1, 1), utc(2023, 2, 2))
    with pytest.raises(InvalidDateRange):
        check_window("1m", utc(2023, 1, 1), utc(2023, 1, 1))
    with pytest.raises(UnsupportedTimeframe):
        check_window("2h", utc(2023, 1, 1), utc(2023, 1, 2))


def kline(wrapped=True, **changes):
    k = {
        "t": 1672531200000, "T": 1672531259999, "s": "BTCUSDT", "i": "1m", "o": "16500.00", "c": "16520.50",
        "h": "16550.00", "l": "16480.00", "v": "123.456", "n": 100, "x": True, "q": "2039520.00", "V": "50.123",
        "Q": "828000.00",
    }
    k.update({key: value for key, value in changes.items() if key not in ("outer", "drop")})
    for key in changes.get("drop", ()):
        del k[key]
    data = {"e": "kline", "E": 1672531230000, "s": "BTCUSDT", "k": k, **changes.get("outer", {})}
    return json.dumps({"stream": "btcusdt@kline_1m", "data": data} if wrapped else data)


MESSAGES = {
    "wrapped": (kline(), "kline", None),
    "bare": (kline(wrapped=False), "kline", None),
    "numbers": (kline(o=16500, h=16550.5), "kline", None),
    "padded": (kline(outer={"s": "  ethusdt  "}), "kline", None),
    "inner symbol": (kline(outer={"s": ""}), "kline", None),
    "bad optional": (kline(q="n/a", n="x"), "kline", None),
    "no optional": (kline(drop=("q", "n", "V", "Q", "i")), "kline", None),
    "ack": ('{"result": null, "id": 1}', "control", None),
    "trade": ('{"e": "trade", "s": "X"}', "control", None),
    "empty object": ("{}", "control", None),
    "error": ('{"error": {"code": 2}}', "malformed", "not_a_kline"),
    "null error": ('{"error": null, "e": "kline"}', "malformed", "not_a_kline"),
    "broken": ("{invalid_json: true,", "malformed", "not_a_kline"),
    "truncated": (kline()[:60], "malformed", "not_a_kline"),
    "array": ("[" + kline() + "]", "malformed", "not_a_kline"),
    "number": ("17", "malformed", "not_a_kline"),
    "no k": ('{"e": "kline", "s": "BTCUSDT"}', "malformed", "not_a_kline"),
    "text k": ('{"e": "kline", "s": "BTCUSDT", "k": "x"}', "malformed", "not_a_kline"),
    "no open": (kline(drop=("o",)), "malformed", "missing_number"),
    "text price": (kline(o="not_a_number"), "malformed", "missing_number"),
    "no time": (kline(drop=("t",)), "malformed", "missing_time"),
    "no symbol": (kline(s="", outer={"s": " "}), "malformed", "blank_symbol"),
    "no flag": (kline(drop=("x",)), "malformed", "missing_flag"),
    "text flag": (kline(x="true"), "malformed", "missing_flag"),
    "zero open": (kline(o="0.0"), "malformed", "price_not_positive"),
    "negative close": (kline(c="-100.0"), "malformed", "price_not_positive"),
    "negative volume": (kline(v="-0.01"), "malformed", "negative_volume"),
    "high below low": (kline(h="100", l="200", o="150", c="150"), "malformed", "high_below_low"),
    "open above high": (kline(h="100", l="50", o="120", c="80"), "malformed", "open_out_of_range"),
    "close below low": (kline(h="100", l="50", o="80", c="40"), "malformed", "close_out_of_range"),
    "closes early": (kline(t=1672531259999, T=1672531200000), "malformed", "close_before_start"),
    "nan": (kline(o="NaN"), "malformed", "not_finite"),
    "infinite": (kline(h="Infinity"), "malformed", "not_finite"),
    "negative quote volume": (kline(q="-1"), "malformed", "bad_optional_volume"),
}


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in MESSAGES.items()], "name string, value string")
    return parse_klines(df, received_at=F.lit(BASE))


def test_message_kinds_and_reasons(parsed):
    got = {r.name: (r.kind, r.reject_reason) for r in parsed.collect()}
    assert got == {name: (kind, reason) for name, (_, kind, reason) in MESSAGES.items()}


def test_parsed_event_fields(parsed):
    rows = {r.name: r for r in good_events(parsed).collect()}
    row = rows["wrapped"]
    assert (row.symbol, row.interval, row.open, row.high, row.low, row.close) == ("BTCUSDT", "1m", 16500.0, 16550.0, 16480.0, 16520.5)
    assert (row.volume, row.quote_volume, row.trade_count) == (123.456, 2039520.0, 100)
    assert (row.taker_buy_base_volume, row.taker_buy_quote_volume) == (50.123, 828000.0)
    assert row.timestamp == datetime(2023, 1, 1) and row.close_time == datetime(2023, 1, 1, 0, 0, 59, 999000)
    assert row.event_time == datetime(2023, 1, 1, 0, 0, 30)
    assert rows["bare"][2:] == row[2:]
    assert rows["padded"].symbol == "ETHUSDT" and rows["inner symbol"].symbol == "BTCUSDT"
    assert rows["bad optional"].quote_volume is None and rows["no optional"].interval == "1m"


def test_unfinished_candles_are_not_final(spark):
    df = spark.createDataFrame([(kline(x=False),), (kline(),)], "value string")
    assert final_events(good_events(parse_klines(df))).count() == 1


def test_pages_from_files(spark, folder):
    good = [[1672531200000 + i * 60000, "100", "110", "90", "105", "7", 0, "1", 5, "1", "1", "0"] for i in range(3)]
    short = [good[0][:5]]
    for name, doc in {"good": good, "short": short, "object": {"code": -1121}, "empty": [], "low": [[1, "10", "5", "8", "9", "1"]]}.items():
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(doc, f, indent=1)
    rows = parse_pages(read_pages(spark, folder))
    reasons = sorted((r.page_id.rsplit("/", 1)[1], r.reject_reason or "") for r in rows.collect())
    assert reasons == [("good.json", "")] * 3 + [("low.json", "high_below_low"), ("object.json", "not_a_page"), ("short.json", "short_kline")]
    kept = good_klines(rows).orderBy("arrival_seq").collect()
    assert [r.timestamp.minute for r in kept] == [0, 1, 2] and kept[0].close == 105.0


def events(spark, rows):
    """Rows of (symbol, minute, open)."""
    df = spark.createDataFrame([(s, at(m), float(o), i) for i, (s, m, o) in enumerate(rows)], "symbol string, timestamp timestamp, open double, arrival_seq long")
    return df.select(
        "symbol", F.lit("1m").alias("interval"), "timestamp",
        F.timestamp_seconds(F.unix_seconds("timestamp") + 59).alias("close_time"), "open",
        (F.col("open") + 1).alias("high"), (F.col("open") - 1).alias("low"), F.col("open").alias("close"),
        F.lit(10.5).alias("volume"), F.lit(None).cast("double").alias("quote_volume"), F.lit(1).cast("long").alias("trade_count"),
        F.lit(None).cast("double").alias("taker_buy_base_volume"), F.lit(None).cast("double").alias("taker_buy_quote_volume"),
        F.lit(True).alias("is_closed"), F.lit("feed").alias("source"), F.lit(None).cast("timestamp").alias("event_time"),
        F.lit(BASE).alias("received_at"), "arrival_seq",
    )


def test_unknown_and_inactive_symbols_are_counted_apart(spark):
    feed = events(spark, [("btcusdt ", 0, 100), ("BTCUSDT", 0, 200), ("DELISTEDUSDT", 0, 100), ("NOPE", 0, 100), ("ETHUSDT", 1, 0.5)])
    classified = classify_events(feed, assets(spark))
    row = ingest_audit(classified).first()
    assert row.asDict() == {"received": 4, "rejected": 1, "unmapped": 1, "inactive": 1, "duplicate": 1, "persisted": 1}
    first = dedup_first(classified.where("outcome = 'accepted'").select("asset_id", "timestamp", "open", "arrival_seq")).first()
    assert (first.asset_id, first.open) == (1, 100.0)


def test_shards_cover_and_agree(spark):
    symbols = spark.range(200).select(F.concat(F.lit("coin_"), "id", F.lit("_usdt ")).alias("symbol"))
    sizes = {r.shard_id: r.symbols for r in shard_sizes(symbols).collect()}
    assert len(sizes) == 8 and min(sizes.values()) > 0 and sum(sizes.values()) == 200
    assigned = {(r.symbol.strip().upper(), r.shard_id) for r in with_shard(symbols).collect()}
    for shard in range(8):
        listed = [r.symbol for r in symbols_of_shard(symbols, shard).collect()]
        assert listed == sorted(s for s, n in assigned if n == shard)
    import hashlib

    for symbol, shard in assigned:
        assert int.from_bytes(hashlib.sha256(symbol.encode()).digest()[:8], "big") % 8 == shard


def test_alert_rules(spark):
    samples = [("dlq_job_count", at(m), v) for m, v in enumerate([0, 3, 3, 3, 12, 12, 12, 12, 12, 12, 0, 5, 5])]
    samples += [("cagg_refresh_pending_jobs", at(m), 60.0) for m in range(50, 70)]
    df = spark.createDataFrame([(m, t, float(v)) for m, t, v in samples], "metric string, ts timestamp, value double")
    got = sustained_alerts(df)
    assert minutes_of(got, "alert", "started_at", "ended_at", "samples") == [
        ("CaggRefreshQueueBuildup", 50, 69, 20),
        ("DeadLetterQueueCritical", 4, 9, 6),
        ("DeadLetterQueueWarning", 1, 9, 9),
    ]


def test_page_plan_splits_at_a_thousand(spark):
    df = spark.createDataFrame([(1, at(0), at(2500)), (2, at(0), at(1000)), (3, at(5), at(5))], "id int, start_time timestamp, end_time timestamp")
    got = minutes_of(page_plan(df), "id", "page_no", "page_start", "page_end")
    assert got == [(1, 0, 0, 1000), (1, 1, 1000, 2000), (1, 2, 2000, 2500), (2, 0, 0, 1000)]


def test_non_finite_and_missing_prices_are_refused(spark):
    rows = [(at(0), float("nan"), 1.0), (at(0), float("inf"), 1.0), (at(0), None, 1.0), (at(0), 1.0, float("nan")), (None, 1.0, 1.0), (at(0), 1.0, 0.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp, open double, volume double")
    df = df.select("timestamp", "open", F.col("open").alias("high"), F.col("open").alias("low"), F.col("open").alias("close"), "volume")
    got = [r[0] for r in df.select(candle_reject_reason()).collect()]
    assert got == ["not_finite", "not_finite", "missing_number", "not_finite", "missing_time", None]


def test_cascade_equals_direct(spark):
    rows = candles(spark, [(a, at(m * 7.0), 100.0 + m % 13, 120.0 + m % 7, 80.0 - m % 5, 100.0 - m % 11, float(m % 4)) for a in (1, 2) for m in range(800)])
    for tier, df in rollup_cascade(rows).items():
        assert sorted(df.collect()) == sorted(rollup(rows, tier).select(*df.columns).collect())
