"""First-write-wins: one row per (asset, time), whatever the order or repetition of arrival."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wickmill.schemas import CANDLE_COLUMNS, OHLCV
from wickmill.timeframes import as_utc

CANDLE_KEY = ("asset_id", "timestamp")
ARRIVAL = "arrival_seq"

# Fixed value: rows older than this many days go to staging.
LIVE_DAYS = 7

# Arrival numbers of one feed stay below this; the feed's rank is counted in multiples of it.
_FEED_SPAN = 1 << 56


def dedup_first(df: DataFrame, keys: Sequence[str] = CANDLE_KEY, arrival: str = ARRIVAL) -> DataFrame:
    """The row with the lowest arrival number of each key.

    A grouped ``min_by`` instead of a ranked window: copies of one key are combined map-side, so a key
    repeated without limit costs one buffer rather than one huge group. ``arrival`` may be a struct; then a row is taken whole even
    where copies tie. A plain arrival number must be unique within a key, else the values of one row may come from several copies.
    """
    others = [c for c in df.columns if c not in (*keys, arrival)]
    if isinstance(df.schema[arrival].dataType, StructType):
        first = F.min_by(F.struct(*others), F.struct(arrival, *others)).alias("_first")
        return df.groupBy(*keys).agg(first, F.min(arrival).alias(arrival)).select(*keys, "_first.*", arrival)
    return df.groupBy(*keys).agg(
        *[F.min_by(c, arrival).alias(c) for c in others], F.min(arrival).alias(arrival)
    )


def feed_rank(rank: int, arrival: Column | str = ARRIVAL) -> Column:
    """Arrival number that puts every row of feed ``rank`` ahead of feed ``rank + 1``."""
    arrival = F.col(arrival) if isinstance(arrival, str) else arrival
    return F.lit(rank * _FEED_SPAN).cast("bigint") + arrival


def feed_union(*feeds: DataFrame, keys: Sequence[str] = CANDLE_KEY, arrival: str = ARRIVAL) -> DataFrame:
    """Several feeds as one table; earlier feeds win, inside a feed the earlier arrival wins."""
    ranked = [df.withColumn(arrival, feed_rank(i, arrival)) for i, df in enumerate(feeds)]
    return dedup_first(reduce(DataFrame.unionByName, ranked), keys, arrival).drop(arrival)


def merge_union(base: DataFrame, staged: DataFrame, keys: Sequence[str] = CANDLE_KEY) -> DataFrame:
    """Base rows plus the staged rows whose key the base lacks. Each side holds one row per key."""
    sides = [side.withColumn(ARRIVAL, F.lit(0).cast("bigint")) for side in (base, staged)]
    return feed_union(*sides, keys=keys)


def absent_rows(new: DataFrame, existing: DataFrame, keys: Sequence[str] = CANDLE_KEY) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet.

    Always sorted and merged: the planner sees the size of compressed files and would broadcast keys that take many times as much in a task.
    """
    return new.join(existing.select(*keys).hint("merge"), list(keys), "left_anti")


def value_conflicts(new: DataFrame, existing: DataFrame, keys: Sequence[str] = CANDLE_KEY) -> DataFrame:
    """Rows that first-write-wins ignores although their values differ from the stored ones."""
    stored = existing.select(*keys, *[F.col(c).alias(f"stored_{c}") for c in OHLCV])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"stored_{c}")) for c in OHLCV])
    return new.join(stored, list(keys)).where(differs)


def live_cutoff(as_of: datetime, days: int = LIVE_DAYS) -> datetime:
    return as_utc(as_of) - timedelta(days=days)


def with_target(candles: DataFrame, as_of: datetime, days: int = LIVE_DAYS) -> DataFrame:
    """Mark each row for the base table or for staging."""
    old = F.col("timestamp") < F.lit(live_cutoff(as_of, days))
    return candles.withColumn("target", F.when(old, "staging").otherwise("base"))


def split_by_age(candles: DataFrame, as_of: datetime, days: int = LIVE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Rows for the base table and rows for staging."""
    cutoff = F.lit(live_cutoff(as_of, days))
    return candles.where(F.col("timestamp") >= cutoff), candles.where(F.col("timestamp") < cutoff)


def staged_days(staged: DataFrame) -> DataFrame:
    """Distinct UTC days waiting in staging, oldest first."""
    return staged.select(F.to_date("timestamp").alias("day")).distinct().orderBy("day")


def candle_columns(df: DataFrame) -> DataFrame:
    return df.select(*CANDLE_COLUMNS)
