"""Rollup tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickmill.catalog import inputs as I
from wickmill.catalog.registry import query
from wickmill.functions.time import align_end, align_start, time_bucket
from wickmill.operators.rollup import all_tiers, rollup, rollup_cascade, rollup_settled_tiers, touched_rows
from wickmill.timeframes import ROLLUP_TIERS


def _register_tier(tier: str) -> None:
    @query(f"rollup_{tier}", I.rollup_sql(I.TYPE_CANDLES, I.TIER_WIDTHS_SQL[tier]))
    def run(spark, sf_dir):
        return rollup(I.type_candles(spark, sf_dir), tier)


for _tier in ROLLUP_TIERS:
    _register_tier(_tier)


@query("rollup_cascade_1d", I.rollup_sql(I.TYPE_CANDLES, "1 day"))
def rollup_cascade_1d(spark, sf_dir):
    return rollup_cascade(I.type_candles(spark, sf_dir))["1d"]


@query("rollup_all_tiers", I.all_tiers_sql(I.USER_CANDLES))
def rollup_all_tiers(spark, sf_dir):
    return all_tiers(I.user_candles(spark, sf_dir))


_HORIZON = I.utc(2024, 1, 20, 10, 37)


@query(
    "rollup_horizon",
    " UNION ALL ".join(
        f"SELECT '{tier}' AS tier, * FROM ({I.rollup_sql(I.TYPE_CANDLES, I.TIER_WIDTHS_SQL[tier])}) "
        f"WHERE \"timestamp\" + INTERVAL '{I.TIER_WIDTHS_SQL[tier]}' <= TIMESTAMP '2024-01-20 10:37:00' - INTERVAL '{off}'"
        for tier, off in
        {"5m": "1 minute", "15m": "1 minute", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}.items()
    ),
)
def rollup_horizon(spark, sf_dir):
    """All tiers up to their horizons in one scan."""
    return rollup_settled_tiers(I.type_candles(spark, sf_dir), _HORIZON)


@query(
    "touched_buckets",
    f"""
    WITH c AS ({I.TYPE_CANDLES})
    SELECT * FROM c WHERE (asset_id, time_bucket(INTERVAL '15 minutes', "timestamp")) IN (
        SELECT (asset_id, time_bucket(INTERVAL '15 minutes', "timestamp")) FROM c WHERE volume > 1)
    """,
)
def touched_buckets(spark, sf_dir):
    candles = I.type_candles(spark, sf_dir)
    return touched_rows(candles, candles.where(F.col("volume") > 1), "15m")


@query(
    "time_bucket",
    "SELECT event_id, "
    + ", ".join(f"time_bucket(INTERVAL '{w}', ts) AS bucket_{t}" for t, w in I.TIER_WIDTHS_SQL.items())
    + " FROM events",
)
def time_buckets(spark, sf_dir):
    return I.events(spark, sf_dir).select(
        "event_id", *[time_bucket("ts", tier).alias(f"bucket_{tier}") for tier in ROLLUP_TIERS]
    )


@query(
    "bucket_align",
    "WITH w AS (SELECT event_id, ts AS s, date_trunc('minute', ts) + to_minutes(CAST(floor(value) AS BIGINT)) AS e"
    " FROM events) SELECT event_id, "
    + ", ".join(
        f"time_bucket(INTERVAL '{w}', s) AS start_{t}, "
        f"CASE WHEN time_bucket(INTERVAL '{w}', e) = e THEN e "
        f"ELSE time_bucket(INTERVAL '{w}', e) + INTERVAL '{w}' END AS end_{t}"
        for t, w in I.TIER_WIDTHS_SQL.items()
    )
    + ", date_trunc('day', s) AS start_any,"
    " CASE WHEN date_trunc('day', e) = e THEN e ELSE date_trunc('day', e) + INTERVAL 1 DAY END AS end_any FROM w",
)
def bucket_align(spark, sf_dir):
    minutes = F.floor("value").cast("bigint")
    end = F.timestamp_seconds(F.unix_seconds(time_bucket("ts", "1m")) + minutes * 60)
    windows = I.events(spark, sf_dir).select("event_id", F.col("ts").alias("s"), end.alias("e"))
    aligned = [
        f(c, tier).alias(f"{label}_{tier or 'any'}")
        for tier in (*ROLLUP_TIERS, None)
        for label, f, c in (("start", align_start, "s"), ("end", align_end, "e"))
    ]
    return windows.select("event_id", *aligned)
