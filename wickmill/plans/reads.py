"""The bounded candle read, for one request and for a table of requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickmill.functions.time import span_days, to_utc
from wickmill.schemas import OHLCV
from wickmill.sources.tables import read_candles
from wickmill.timeframes import INTERACTIVE_LIMIT_DAYS, TIER_LIMIT_DAYS, TIER_SECONDS, check_window, tier_path


class AssetNotFound(LookupError):
    """No asset has the requested id."""


def candle_view(candles: DataFrame) -> DataFrame:
    """Output columns of a read, prices and volume as doubles."""
    return candles.select("timestamp", *[F.col(c).cast("double").alias(c) for c in OHLCV])


def candles(
    spark: SparkSession,
    root: str,
    asset_id: int,
    tier: str,
    start: datetime,
    end: datetime,
    assets: DataFrame | None = None,
    mode: str = "interactive",
) -> DataFrame:
    """Candles of one asset and tier in ``[start, end)``, in time order.

    Tier, order and span are checked before any job runs; the asset is looked up when ``assets`` is
    given.
    """
    start, end = check_window(tier, start, end, mode)
    if assets is not None and assets.where(F.col("id") == asset_id).isEmpty():
        raise AssetNotFound(f"The registry has no asset {asset_id}")
    rows = read_candles(spark, tier_path(root, tier), start, end, asset_id)
    return candle_view(rows).orderBy("timestamp")


def check_requests(requests: DataFrame, assets: DataFrame, mode: str = "interactive") -> DataFrame:
    """Requests (asset_id, timeframe, start_time, end_time) with ``reject_reason``.

    Reasons in the order they are tested: ``unsupported_timeframe``, ``bad_range``, ``span_too_long``,
    ``unknown_asset``. Naive times are read as UTC before they are compared.
    """
    zoned = requests.withColumn("start_time", to_utc("start_time")).withColumn("end_time", to_utc("end_time"))
    days = span_days("start_time", "end_time")
    too_long = F.lit(False)
    for tier, limit in TIER_LIMIT_DAYS.items():
        caps = [x for x in (limit, INTERACTIVE_LIMIT_DAYS if mode == "interactive" else None) if x is not None]
        if caps and mode != "export":
            too_long = F.when(F.col("timeframe") == tier, days > min(caps)).otherwise(too_long)
    known = assets.select(F.col("id").alias("asset_id"), F.lit(True).alias("_known")).distinct()
    reason = F.coalesce(
        F.when(~F.col("timeframe").isin(*TIER_SECONDS), "unsupported_timeframe"),
        F.when(F.col("start_time") >= F.col("end_time"), "bad_range"),
        F.when(too_long, "span_too_long"),
        F.when(F.col("_known").isNull(), "unknown_asset"),
    )
    return zoned.join(known, "asset_id", "left").withColumn("reject_reason", reason).drop("_known")
