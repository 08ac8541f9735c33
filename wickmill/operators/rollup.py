"""Candle rollups: 5m, 15m, 1h, 4h and 1d tiers of base candles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickmill.functions.time import day_start, time_bucket
from wickmill.timeframes import ROLLUP_TIERS, TIER_END_OFFSET_SECONDS, as_utc, tier_seconds

KEYS = ("asset_id",)
DAY = "_day_start"


def ohlcv_aggregates(time: str = "timestamp") -> list[Column]:
    """First open, highest high, lowest low, last close, total volume."""
    return [
        F.min_by("open", time).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", time).alias("close"),
        F.sum("volume").alias("volume"),
    ]


def rollup(candles: DataFrame, tier: str, keys: Sequence[str] = KEYS, within: Sequence[str] = ()) -> DataFrame:
    """One tier. Expects one row per (key, timestamp).

    ``within`` names extra grouping columns implied by the bucket (such as its day); grouping by them
    lets an existing partitioning be used again.
    """
    bucket = time_bucket("timestamp", tier).alias("timestamp")
    return candles.groupBy(*keys, *within, bucket).agg(*ohlcv_aggregates())


def rollup_cascade(candles: DataFrame, keys: Sequence[str] = KEYS) -> dict[str, DataFrame]:
    """All tiers from one pass over the base.

    The 5-minute tier is combined map-side; its rows are then partitioned once by (key, day), and the
    four coarser tiers are built from the next finer tier without another exchange.
    """
    finest = ROLLUP_TIERS[0]
    tiers = {finest: rollup(candles, finest, keys)}
    current = tiers[finest].withColumn(DAY, day_start("timestamp")).repartition(*keys, DAY)
    for tier in ROLLUP_TIERS[1:]:
        current = rollup(current, tier, keys, within=(DAY,))
        tiers[tier] = current.drop(DAY)
    return tiers


def all_tiers(candles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every tier in one table with a ``tier`` column."""
    labelled = [df.withColumn("tier", F.lit(tier)) for tier, df in rollup_cascade(candles, keys).items()]
    return reduce(DataFrame.unionByName, labelled)


def settled_before(tier: str, as_of: datetime) -> datetime:
    """End of the last bucket a scheduled refresh at ``as_of`` writes."""
    width = timedelta(seconds=tier_seconds(tier))
    limit = as_utc(as_of) - timedelta(seconds=TIER_END_OFFSET_SECONDS[tier])
    epoch = as_utc(datetime(1970, 1, 1))
    return epoch + (limit - epoch) // width * width


def rollup_settled_tiers(candles: DataFrame, as_of: datetime, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every tier up to its own refresh horizon, from one pass, with a ``tier`` column.

    A horizon lies on a bucket edge of its tier, so what a coarser tier leaves out are whole buckets. The latest horizon bounds the scan.
    """
    horizons = {tier: settled_before(tier, as_of) for tier in ROLLUP_TIERS}
    held = candles.where(F.col("timestamp") < F.lit(max(horizons.values())))
    settled = [
        df.where(F.col("timestamp") < F.lit(horizons[tier])).withColumn("tier", F.lit(tier))
        for tier, df in rollup_cascade(held, keys).items()
    ]
    return reduce(DataFrame.unionByName, settled)


def touched_days(windows: DataFrame, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Distinct UTC days inside half-open windows."""
    last = F.timestamp_micros(F.unix_micros(end) - 1)
    days = F.sequence(F.to_date(start), F.to_date(last))
    return windows.where(F.col(start) < F.col(end)).select(F.explode(days).alias("day")).distinct()


def touched_rows(candles: DataFrame, changed: DataFrame, tier: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Base candles in the buckets of a tier that the changed rows fall into."""
    buckets = changed.select(*keys, time_bucket("timestamp", tier).alias("_bucket")).distinct()
    return candles.withColumn("_bucket", time_bucket("timestamp", tier)).join(
        buckets, [*keys, "_bucket"], "left_semi"
    ).drop("_bucket")
