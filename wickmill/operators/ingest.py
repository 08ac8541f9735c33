"""Steps of an ingest: reject, map, order, count. Bad rows keep a reason instead of failing a batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickmill.functions.checks import event_reject_reason
from wickmill.operators.assets import enrich_symbols
from wickmill.operators.ordered import CHUNK, running_max

# Fixed value: pending rows one asset may hold before it counts as hot.
PENDING_PER_ASSET = 2000

# Rows of one batch that are compared in one task by the order check.
ORDER_SLICE = 65536


def classify_events(events: DataFrame, assets: DataFrame, exchange: str | None = None) -> DataFrame:
    """Add ``asset_id`` and ``outcome``: ``accepted`` or the reason a row is kept out of the table."""
    checked = events.withColumn("_reject", event_reject_reason())
    mapped = enrich_symbols(checked, assets, exchange)
    outcome = F.coalesce(
        F.when(F.col("_reject").isNotNull(), F.concat(F.lit("rejected:"), F.col("_reject"))),
        F.when(~F.col("is_closed"), F.lit("rejected:not_closed")),
        F.col("map_reject"),
        F.lit("accepted"),
    )
    return mapped.withColumn("outcome", outcome).drop("_reject", "map_reject")


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") == "accepted")


def quarantined(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") != "accepted")


def ingest_audit(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters of a classified batch. Copies of a key fold first, so one hot key is one partial row."""
    folded = classified.groupBy(*by, "outcome", "asset_id", "timestamp").agg(F.count("*").alias("_rows"))
    rejected = F.col("outcome").startswith("rejected:")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("_rows"))), F.lit(0)).cast("bigint")

    kept = F.col("outcome") == "accepted"
    return folded.groupBy(*by).agg(
        total(~rejected).alias("received"),
        total(rejected).alias("rejected"),
        total(F.col("outcome") == "unmapped").alias("unmapped"),
        total(F.col("outcome") == "inactive").alias("inactive"),
        F.coalesce(F.sum(F.when(kept, F.col("_rows") - 1)), F.lit(0)).cast("bigint").alias("duplicate"),
        F.count_if(kept).alias("persisted"),
    )


def hot_keys(rows: DataFrame, cap: int = PENDING_PER_ASSET, key: str = "symbol") -> DataFrame:
    """Keys with more rows than the cap. A report only: no row is dropped."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > cap)


def page_order(
    rows: DataFrame,
    batch: Sequence[str] = ("batch_id",),
    *more: Column,
    arrival: str = "arrival_seq",
    time: str = "timestamp",
) -> DataFrame:
    """One row per page: is any time at or before an earlier one in arrival order? ``more`` aggregates join the row.

    A page is strictly rising exactly when every time exceeds the maximum of those ahead of it.
    """
    place = F.coalesce(F.col(arrival), F.lit(0).cast("bigint"))
    sliced = rows.withColumn(CHUNK, F.floor(place / F.lit(ORDER_SLICE)).cast("bigint"))
    compared = running_max(sliced, batch, [arrival], F.col(time), "_ahead")
    fell = F.coalesce(F.col(time) <= F.col("_ahead"), F.lit(False))
    return compared.groupBy(*batch).agg(F.count("*").alias("rows"), F.bool_or(fell).alias("disordered"), *more)


def ordered_pages(rows: DataFrame, batch: Sequence[str] = ("batch_id",), **names: str) -> DataFrame:
    """Rows of the pages that pass the order check; a disordered page is refused whole."""
    good = page_order(rows, batch, **names).where(~F.col("disordered"))
    return rows.join(good.select(*batch), list(batch), "left_semi")


def time_sorted(candles: DataFrame) -> DataFrame:
    """Chronological order per asset. Range partitions split a hot asset by time, unlike a hash."""
    return candles.repartitionByRange("asset_id", "timestamp").sortWithinPartitions("asset_id", "timestamp")
