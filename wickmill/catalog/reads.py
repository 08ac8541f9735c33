"""Bounded reads, request checks and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickmill.catalog import inputs as I
from wickmill.catalog.registry import query
from wickmill.operators.rollup import rollup
from wickmill.plans.reads import candle_view, candles, check_requests
from wickmill.plans.refresh import base_path, refresh_days
from wickmill.operators.assets import active_assets
from wickmill.session import scratch_dir
from wickmill.sources import outputs as O
from wickmill.sources.tables import stored_days, write_candles


@query(
    "candle_range",
    f"""SELECT "timestamp", open, high, low, close, volume FROM ({I.TYPE_CANDLES})
        WHERE asset_id = 'purchase' AND "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-20'
        ORDER BY "timestamp\"""",
)
def candle_range(spark, sf_dir):
    bounds = (F.col("timestamp") >= F.lit(I.utc(2024, 1, 5))) & (F.col("timestamp") < F.lit(I.utc(2024, 1, 20)))
    rows = I.type_candles(spark, sf_dir).where((F.col("asset_id") == "purchase") & bounds)
    return candle_view(rows).orderBy("timestamp")


@query("candle_project", f'SELECT "timestamp", open, high, low, close, volume FROM ({I.TYPE_CANDLES})')
def candle_project(spark, sf_dir):
    return candle_view(I.type_candles(spark, sf_dir))


@query(
    "tier_read",
    f"""SELECT "timestamp", open, high, low, close, volume FROM ({I.rollup_sql(I.USER_CANDLES, '4 hours')})
        WHERE asset_id = 8 AND "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" < TIMESTAMP '2024-01-28'
        ORDER BY "timestamp\"""",
)
def tier_read(spark, sf_dir):
    root = scratch_dir(spark, "read")
    write_candles(I.user_candles(spark, sf_dir), base_path(root))
    refresh_days(spark, root, stored_days(spark, base_path(root)))
    return candles(spark, root, 8, "4h", I.utc(2024, 1, 3), I.utc(2024, 1, 28), I.assets(spark, sf_dir))


# Requests: tier by priority, span by price, from ten days before to 350 days after the start.
_REQUESTS = """
        SELECT o_orderkey AS id, CAST(o_custkey AS INTEGER) AS asset_id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1m' WHEN '2' THEN '5m' WHEN '3' THEN '15m'
                    WHEN '4' THEN '1d' ELSE '2h' END AS timeframe,
               o_orderdate AS start_time,
               o_orderdate + to_hours(CAST(floor(o_totalprice / 50) AS BIGINT) - 240) AS end_time
        FROM orders"""


def _requests(spark, sf_dir):
    digit = F.substring("o_orderpriority", 1, 1)
    tier = F.when(digit == "1", "1m").when(digit == "2", "5m").when(digit == "3", "15m").when(digit == "4", "1d")
    start = F.col("o_orderdate").cast("timestamp")
    hours = F.floor(F.col("o_totalprice") / 50).cast("bigint") - 240
    return I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("int").alias("asset_id"),
        tier.otherwise("2h").alias("timeframe"),
        start.alias("start_time"),
        F.timestamp_seconds(F.unix_seconds(start) + hours * 3600).alias("end_time"),
    )


def _checked_sql(limit: str) -> str:
    return f"""
        SELECT id, asset_id, CASE WHEN timeframe = '2h' THEN 'unsupported_timeframe'
                    WHEN start_time >= end_time THEN 'bad_range'
                    WHEN date_diff('hour', start_time, end_time) // 24 > {limit} THEN 'span_too_long'
                    WHEN asset_id NOT IN (SELECT id FROM ({I.ASSETS}) WHERE is_active) THEN 'unknown_asset'
               END AS reject_reason
        FROM ({_REQUESTS})"""


@query(
    "request_validate",
    _checked_sql("CASE timeframe WHEN '1m' THEN 30 WHEN '5m' THEN 90 WHEN '15m' THEN 180 ELSE 1000000 END"),
)
def request_validate(spark, sf_dir):
    checked = check_requests(_requests(spark, sf_dir), active_assets(I.assets(spark, sf_dir)), mode="service")
    return checked.select("id", "asset_id", "reject_reason")


@query("interactive_cap", _checked_sql("30"))
def interactive_cap(spark, sf_dir):
    checked = check_requests(_requests(spark, sf_dir), active_assets(I.assets(spark, sf_dir)), mode="interactive")
    return checked.select("id", "asset_id", "reject_reason")


# Export jobs: one per customer, three days from a start that depends on the nation.
_EXPORTS = """
        SELECT c_custkey AS job_id, CAST(c_custkey AS INTEGER) AS asset_id, '5m' AS timeframe,
               TIMESTAMP '2024-01-01' + to_days(c_nationkey) AS start_time,
               TIMESTAMP '2024-01-04' + to_days(c_nationkey) AS end_time
        FROM customer"""

_EXPORTED = f"""
        SELECT e.job_id, e.asset_id, e.timeframe, c."timestamp", c.open, c.high, c.low, c.close, c.volume
        FROM ({_EXPORTS}) e JOIN ({I.rollup_sql(I.USER_CANDLES, '5 minutes')}) c
          ON c.asset_id = e.asset_id AND c."timestamp" >= start_time AND c."timestamp" < end_time"""


def _exports(spark, sf_dir):
    day0 = 1704067200

    def day(offset: int):
        return F.timestamp_seconds(F.lit(day0) + (F.col("c_nationkey") + offset).cast("bigint") * 86400)

    return I.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("job_id"),
        F.col("c_custkey").cast("int").alias("asset_id"),
        F.lit("5m").alias("timeframe"),
        day(0).alias("start_time"),
        day(3).alias("end_time"),
    )


@query("export_request", _EXPORTED)
def export_request(spark, sf_dir):
    tier = rollup(I.user_candles(spark, sf_dir), "5m")
    rows = O.requested_candles(tier, _exports(spark, sf_dir), "5m")
    return rows.drop("start_time", "end_time")


@query(
    "export_layout",
    f"""SELECT 'exports/' || asset_id || '/' || timeframe || '/' || job_id || '.parquet' AS object_key,
               count(*) AS "rows", sum(volume) AS volume FROM ({_EXPORTED}) GROUP BY ALL""",
)
def export_layout(spark, sf_dir):
    root = scratch_dir(spark, "exports")
    requests = _exports(spark, sf_dir)
    O.export_requests(rollup(I.user_candles(spark, sf_dir), "5m"), requests, root, "5m")
    written = O.exported_candles(requests, root, "5m")
    key = O.export_key("asset_id", "timeframe", "job_id")
    return written.groupBy(key.alias("object_key")).agg(F.count("*").alias("rows"), F.sum("volume").alias("volume"))


_CLICKS = f"""SELECT "timestamp", open, high, low, close, volume FROM ({I.TYPE_CANDLES}) WHERE asset_id = 'click'
              ORDER BY "timestamp\""""


@query("parquet_export", _CLICKS)
def parquet_export(spark, sf_dir):
    path = scratch_dir(spark, "export")
    O.export_parquet(I.type_candles(spark, sf_dir).where("asset_id = 'click'"), path)
    return spark.read.parquet(path).orderBy("timestamp")


@query(
    "ndjson_sink",
    f"""SELECT '{{"timestamp":"' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '+00:00","open":' || open
               || ',"high":' || high || ',"low":' || low || ',"close":' || close || ',"volume":' || volume || '}}' AS value
        FROM ({_CLICKS})""",
)
def ndjson_sink(spark, sf_dir):
    path = scratch_dir(spark, "ndjson")
    O.write_ndjson(I.type_candles(spark, sf_dir).where("asset_id = 'click'"), path)
    return spark.read.text(path)
