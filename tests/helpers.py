"""Small builders for hand-written rows."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from wickmill.schemas import ASSET, CANDLE, RANGE

BASE = datetime(2026, 1, 1, 10, 0, tzinfo=timezone.utc)


def at(minutes: float, base: datetime = BASE) -> datetime:
    return base + timedelta(minutes=minutes)


def naive(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


def candle_rows(minutes, asset_id=1, base=BASE, price=100.0, volume=10.0):
    return [(asset_id, at(m, base), price, price + 5, price - 5, price + 1, volume) for m in minutes]


def candles(spark, rows):
    return spark.createDataFrame(rows, CANDLE)


def ranges(spark, rows):
    """Rows of (asset, start minute, end minute)."""
    return spark.createDataFrame([(a, at(s), at(e)) for a, s, e in rows], RANGE)


def requests(spark, rows):
    return spark.createDataFrame(
        [(a, at(s), at(e)) for a, s, e in rows],
        "asset_id int, request_start timestamp, request_end timestamp",
    )


def assets(spark):
    """Three active assets and an inactive one."""
    rows = [
        (1, "BTCUSDT", "BINANCE", "SPOT", True, BASE),
        (2, "ETHUSDT", "BINANCE", "SPOT", True, BASE),
        (3, "SOLUSDT", "BINANCE", "SPOT", True, BASE),
        (4, "DELISTEDUSDT", "BINANCE", "SPOT", False, BASE),
    ]
    return spark.createDataFrame(rows, ASSET)


def minutes_of(df, *columns, base=BASE):
    """Rows with times as minutes after the base, sorted."""
    zero = naive(base)

    def value(x):
        return (x - zero).total_seconds() / 60 if isinstance(x, datetime) else x

    return sorted(tuple(value(row[c]) for c in columns) for row in df.collect())
