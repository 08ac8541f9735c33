"""Which windows to fetch: months of a backfill, pages of a window, the last day of every asset."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.timeframes import DAY_SECONDS, TIER_SECONDS, as_utc

# Fixed value: most candles one history page holds.
PAGE_CANDLES = 1000


def month_plan(assets: DataFrame, as_of: datetime, start_year: str = "start_year") -> DataFrame:
    """One row per asset and calendar month from its start year, the last one clipped to ``as_of``."""
    end = F.lit(as_utc(as_of))
    first = F.make_timestamp(F.col(start_year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp")
    months = F.sequence(first, end, F.expr("INTERVAL 1 MONTH"))
    return (
        assets.where(first < end)
        .withColumn("window_start", F.explode(months))
        .where(F.col("window_start") < end)
        .withColumn("window_end", F.least(F.col("window_start") + F.expr("INTERVAL 1 MONTH"), end))
    )


def page_plan(windows: DataFrame, start: str = "start_time", end: str = "end_time", tier: str = "1m") -> DataFrame:
    """One row per page of at most 1,000 candles of each half-open window."""
    micros = PAGE_CANDLES * TIER_SECONDS[tier] * 1_000_000
    span = F.unix_micros(end) - F.unix_micros(start)
    last_page = F.floor((span - 1) / F.lit(micros)).cast("bigint")
    page_start = F.timestamp_micros(F.unix_micros(start) + F.col("page_no") * micros)
    return (
        windows.where(F.col(start) < F.col(end))
        .withColumn("page_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last_page)))
        .withColumn("page_start", page_start)
        .withColumn("page_end", F.least(F.timestamp_micros(F.unix_micros("page_start") + micros), F.col(end)))
    )


def daily_windows(assets: DataFrame, as_of: datetime) -> DataFrame:
    """The 24 hours up to ``as_of`` for every active asset."""
    end = F.lit(as_utc(as_of))
    start = F.timestamp_micros(F.unix_micros(end) - DAY_SECONDS * 1_000_000)
    return assets.where("is_active").select(
        F.col("id").alias("asset_id"), "symbol", start.alias("window_start"), end.alias("window_end")
    )
