"""Tiers kept current while candles arrive. Provisional: the refresh of touched parts over the base is the truth.

A candle is on time if it arrives at most ``delay`` after its own time. On-time candles pass a stateful removal of copies: all copies of one that
are on time arrive within ``delay`` of each other, so state that is kept so long sees them all, and no longer is needed. What arrives
later may be a copy of a candle that the state has forgotten; it is never added up but noted, and its bucket is computed again from the
base once it is closed (:func:`settle_late`). So redelivered candles count once, and no candle is lost for lateness.

Every micro-batch appends what it adds to its buckets to a log, by day. A log row with ``upto`` stands for all batches up to that one:
that is how a past day is compacted and a bucket settled without touching what others write.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wickmill.functions.time import day_of, seconds_between, shift, time_bucket
from wickmill.operators.rollup import ohlcv_aggregates, rollup, touched_rows
from wickmill.schemas import OHLCV
from wickmill.sources.tables import drop_files, path_of, take_files
from wickmill.timeframes import as_utc, tier_seconds

KEYS = ("asset_id",)
BUCKET = "_bucket"
ARRIVED = "arrived_at"
LATE = "_late"
# Rows that stand for themselves, and rows that stand for every batch of their bucket.
ONE_BATCH, ALL_BATCHES = -1, 2**62


def _late(time: str, delay: timedelta) -> Column:
    return seconds_between(time, ARRIVED) > delay.total_seconds()


def stream_rollup(candles: DataFrame, tier: str, keys: Sequence[str] = KEYS, delay: timedelta | None = None) -> DataFrame:
    """Candles of a stream with the bucket they belong to.

    With a ``delay`` the stream needs ``arrived_at``, the time a candle came in, and ``arrival_seq``, which no two rows share. Copies of on-time
    candles are removed, late ones are marked. Copies are redeliveries: which of several different ones counts is left to the base.
    Without it the stream must hold every candle once, as in what was appended to the base table; then no state is kept.
    """
    bucket = time_bucket("timestamp", tier).alias(BUCKET)
    if delay is None:
        return candles.select(*keys, "timestamp", *OHLCV, bucket, F.lit(False).alias(LATE))
    marked = candles.withWatermark(ARRIVED, f"{int(delay.total_seconds())} seconds").withColumn(LATE, _late("timestamp", delay))
    # A late row is a key of its own: it passes, and waits for its bucket to be settled.
    once = marked.withColumn("_alone", F.when(F.col(LATE), F.col("arrival_seq")))
    unique = once.dropDuplicatesWithinWatermark([*keys, "timestamp", "_alone"])
    return unique.select(*keys, "timestamp", *OHLCV, bucket, LATE)


def _log(rows: DataFrame, path: str, part: str, batch_id: Column, upto: Column, mode: str) -> None:
    """Write log rows by the day of their bucket. ``overwrite`` replaces what the same part wrote before."""
    (
        rows.withColumn("batch_id", batch_id.cast("bigint"))
        .withColumn("upto", upto.cast("bigint"))
        .drop("_to")
        .withColumn("day", day_of("timestamp"))
        .withColumn("part", F.lit(part))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "part")
        .parquet(path)
    )


def late_path(path: str) -> str:
    return f"{path.rstrip('/')}_late"


def start_tier_log(
    rolled: DataFrame, path: str, checkpoint: str, available_now: bool = False, keys: Sequence[str] = KEYS
) -> StreamingQuery:
    """Append what each micro-batch adds to its buckets, and note late rows; a replayed batch replaces its own folders."""

    def write(batch: DataFrame, batch_id: int) -> None:
        number = F.lit(batch_id)
        added = (
            batch.where(~F.col(LATE))
            .groupBy(*keys, BUCKET)
            .agg(*ohlcv_aggregates(), F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))
            .withColumnRenamed(BUCKET, "timestamp")
        )
        _log(added, path, f"batch-{batch_id}", number, F.lit(ONE_BATCH), "overwrite")
        late = batch.where(LATE).groupBy(*keys, F.col(BUCKET).alias("timestamp")).agg(F.count("*").alias("rows"))
        noted = late.withColumn("batch_id", number.cast("bigint"))
        noted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(late_path(path))

    writer = rolled.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _valid(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Log rows that no other row stands for."""
    bucket = Window.partitionBy(*keys, "timestamp")
    reach = log.withColumn("_reach", F.max("upto").over(bucket))
    # Of several rows of one reach, as a broken-off compaction leaves them, one stands for all.
    first = reach.withColumn("_nth", F.row_number().over(bucket.orderBy(F.col("upto").desc(), "batch_id", "part")))
    whole = (F.col("_reach") >= 0) & (F.col("_nth") == 1)
    return first.where(whole | ((F.col("upto") < 0) & (F.col("batch_id") > F.col("_reach")))).drop("_reach", "_nth")


def _folded(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _valid(log, keys).groupBy(*keys, "timestamp").agg(
        F.min_by("open", "first_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_time").alias("close"),
        F.sum("volume").alias("volume"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


def read_tier_log(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every bucket, from the parts that the micro-batches added to it and from what stands for them."""
    return _folded(spark.read.parquet(path), keys).drop("first_time", "last_time")


def read_late(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Late rows that await their bucket's settling: keys, bucket, rows, batch_id. Without any note, none."""
    kinds = dict(spark.read.parquet(path).dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "timestamp")) + ", rows long, batch_id long"
    files, location = path_of(spark, late_path(path))
    return spark.read.schema(schema).parquet(late_path(path)) if files.exists(location) else spark.createDataFrame([], schema)


def settle_late(
    spark: SparkSession, path: str, base: DataFrame, tier: str, delay: timedelta, as_of: datetime, keys: Sequence[str] = KEYS
) -> None:
    """Compute the closed buckets of late rows again from ``base``, the stored candles, and take them off the notes.

    A bucket is closed when no on-time candle can come any more, so what is computed now stands for all its batches. Open ones wait.
    """
    notes = read_late(spark, path, keys)
    names = take_files(spark, notes)
    if not names:
        return
    end = shift("timestamp", int(tier_seconds(tier) + delay.total_seconds()))
    closed, open_ = notes.where(end <= F.lit(as_utc(as_of))), notes.where(end > F.lit(as_utc(as_of)))
    whole = rollup(touched_rows(base, closed, tier, keys), tier, keys)
    settled = whole.withColumn("first_time", F.col("timestamp")).withColumn("last_time", F.col("timestamp"))
    _log(settled, path, f"settled-{as_of:%Y%m%dT%H%M%S%f}", F.lit(ALL_BATCHES), F.lit(ALL_BATCHES), "append")
    # Notes that stay are written anew before the old ones go; a note that is there twice only settles its bucket twice.
    open_.write.mode("append").partitionBy("batch_id").parquet(late_path(path))
    drop_files(spark, names)


def compact_tier_log(spark: SparkSession, path: str, day: date, keys: Sequence[str] = KEYS) -> None:
    """Fold the log of a day into one part. Batches that are logged meanwhile are not touched and count on top."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/day={day.isoformat()}")
    names = take_files(spark, rows)
    batches = rows.where(F.col("batch_id") < ALL_BATCHES)
    reach = batches.agg(F.max(F.greatest("batch_id", "upto"))).first()[0] or 0
    # A settled bucket stays settled.
    reaches = rows.groupBy(*keys, "timestamp").agg(F.greatest(F.max("upto"), F.lit(reach)).alias("_to"))
    folded = _folded(rows, keys).join(reaches, [*keys, "timestamp"])
    _log(folded, path, "folded", F.col("_to"), F.col("_to"), "append")
    drop_files(spark, names)
