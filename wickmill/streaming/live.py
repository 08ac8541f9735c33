"""Live ingest: landed messages to the base table, staging, quarantine, audit and notes of touched parts.

Each micro-batch is one idempotent batch job that only appends. The query's checkpoint replays a batch after a failure,
and a replayed batch adds no row, so at-least-once delivery gives exactly one row per key. Nothing is
dropped for lateness; there is no watermark here. Tiers and coverage follow by ``plans.refresh.refresh_touched``, a job of its own schedule:
it rebuilds each touched part once, however many batches touched it.

A batch's counters are counted over its cached rows and stored per day. They are not observed: where several executors compute the same
cached block, an observation counts its rows once for each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wickmill.operators.ingest import accepted, classify_events, quarantined
from wickmill.plans.refresh import note_touched
from wickmill.plans.repair import write_by_age
from wickmill.schemas import ASSET, AUDIT, EVENT
from wickmill.session import configure
from wickmill.sources.klines import good_events, parse_klines, rejected_messages
from wickmill.sources.tables import drop_files, take_files
from wickmill.timeframes import as_utc

# Fixed value: flush interval of the live feed.
FLUSH_SECONDS = 1

ARRIVAL = "arrival_seq"


@dataclass(frozen=True)
class LiveTarget:
    """Where a live ingest reads its registry and writes its tables."""

    root: str
    assets_path: str
    exchange: str | None = None

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def audit(self) -> str:
        return f"{self.root}/audit"


def _overwrite(df: DataFrame, path: str, *folders: str) -> None:
    """Write one batch's side table by folders; a replay of the batch replaces them."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def ingest_messages(
    spark: SparkSession,
    messages: DataFrame,
    target: LiveTarget,
    batch_id: int,
    as_of: datetime,
    arrival: Column | None = None,
) -> None:
    """One batch of raw messages (``value``) through parse, checks, mapping and first-wins write.

    ``arrival`` orders copies of a candle inside the batch (for a message broker, pass its offset). By default it is
    ``landed``, where ``messages`` has that column, and then the position in the source: Spark reads large files
    first, so the position alone does not tell which file came first.
    """
    # The registry is read anew for every batch, so new and deactivated assets take effect at once.
    assets = spark.read.schema(ASSET).parquet(target.assets_path)
    if arrival is None:
        arrival = F.struct(*(c for c in ("landed",) if c in messages.columns), F.monotonically_increasing_id().alias("position"))
    numbered = messages.select("value", arrival.alias(ARRIVAL))
    parsed = parse_klines(numbered, received_at=F.lit(as_of)).persist(StorageLevel.MEMORY_AND_DISK)
    classified = classify_events(good_events(parsed), assets, target.exchange).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Fills both caches in one pass; a first job over both would compute the parsed rows twice.
        outcomes = {r.outcome: r.n for r in classified.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        refused_rows = rejected_messages(parsed).count()
        refused = rejected_messages(parsed).select("value", F.col("reject_reason").alias("outcome"))
        kept_out = quarantined(classified).select(
            F.to_json(F.struct(*EVENT.fieldNames())).alias("value"), "outcome"
        )
        batch = F.lit(batch_id).cast("bigint").alias("batch_id")
        _overwrite(refused.unionByName(kept_out).select("*", batch), target.quarantine, "batch_id")
        written = write_by_age(spark, target.root, accepted(classified), as_of, ARRIVAL)
        note_touched(spark, target.root, written.base, f"batch-{batch_id}")
        counters = batch_counters(outcomes, refused_rows, written.rows)
        row = (as_utc(as_of).date(), batch_id, *(counters[name] for name in AUDIT.fieldNames()[2:]))
        counted = spark.createDataFrame([row], AUDIT).withColumn("part", F.lit(f"batch-{batch_id}"))
        _overwrite(counted.coalesce(1), target.audit, "day", "part")
    finally:
        classified.unpersist()
        parsed.unpersist()


def batch_counters(outcomes: dict[str, int], refused: int, unique: int) -> dict[str, int]:
    """Counters of one batch. What the parser refuses counts as rejected; copies of a key inside the batch as duplicate."""
    rejected = sum(n for outcome, n in outcomes.items() if outcome.startswith("rejected:"))
    return {
        "batches": 1,
        "received": sum(outcomes.values()) - rejected,
        **{name: outcomes.get(name, 0) for name in ("unmapped", "inactive")},
        "rejected": rejected + refused,
        "duplicate": outcomes.get("accepted", 0) - unique,
        "persisted": unique,
    }


def start_live_ingest(
    messages: DataFrame,
    target: LiveTarget,
    checkpoint: str,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    available_now: bool = False,
    arrival: Column | None = None,
) -> StreamingQuery:
    """Start the live ingest over a stream with a text column ``value``; ``arrival`` as in :func:`ingest_messages`.

    Batch size is the source's bound on bytes, files or offsets (``sources.klines.stream_messages``); the flush interval is the
    trigger. ``available_now`` works off what has landed and stops.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        # A stream's session has adaptive execution off. The stream itself keeps no state, so the batch
        # jobs inside may use it: they rely on it for hot keys, hot days and file sizes.
        ingest_messages(configure(batch.sparkSession), batch, target, batch_id, clock(), arrival)

    writer = messages.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{FLUSH_SECONDS} second").start()


def read_audit(spark: SparkSession, target: LiveTarget) -> DataFrame:
    """Counters per micro-batch."""
    rows = spark.read.schema(AUDIT).parquet(target.audit)
    # A day whose compaction broke off has some batches twice.
    return rows.dropDuplicates(["day", "batch_id"]).select(*AUDIT.fieldNames())


def compact_audit(spark: SparkSession, target: LiveTarget, day: date) -> None:
    """One file for the counters of a past day instead of one per batch."""
    loose = spark.read.schema(AUDIT).option("basePath", target.audit).parquet(f"{target.audit}/day={day.isoformat()}")
    files = take_files(spark, loose)
    # Written next to the loose files, which go after that; new names, so nothing that is read is overwritten.
    once = loose.dropDuplicates(["batch_id"]).coalesce(1).withColumn("part", F.lit("whole"))
    once.write.mode("append").partitionBy("day", "part").parquet(target.audit)
    drop_files(spark, files)
