"""Work ledgers as tables: repair windows, recompute windows and exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickmill.functions.failures import DEFAULT_MAX_RETRIES, error_category, status_after_failure
from wickmill.functions.time import align_end, align_start
from wickmill.timeframes import as_utc

# Ledger states.
PENDING, PROCESSING, COMPLETED, FAILED, CANCELLED = "pending", "processing", "completed", "failed", "cancelled"
ACTIVE = (PENDING, PROCESSING)
REPAIR_STATES = (PENDING, PROCESSING, COMPLETED, FAILED, CANCELLED)
REFRESH_STATES = (PENDING, PROCESSING, COMPLETED, FAILED)

REPAIR_KEY = ["asset_id", "start_time", "end_time"]


def _at(moment: datetime) -> Column:
    return F.lit(as_utc(moment))


def with_status(ledger: DataFrame, *states: str) -> DataFrame:
    return ledger.where(F.col("status").isin(*states))


def eligible_jobs(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """Jobs waiting, or held by a worker whose lease ran out."""
    stale = (F.col("status") == PROCESSING) & (F.col("lease_expires_at") < _at(as_of))
    return ledger.where((F.col("status") == PENDING) | stale)


def oldest_job(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """The eligible job to take next: oldest first, ties by id."""
    return eligible_jobs(ledger, as_of).orderBy("created_at", "id").limit(1)


def job_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count("*").alias("jobs"))


def repair_jobs(gaps: DataFrame, as_of: datetime, max_retries: int = DEFAULT_MAX_RETRIES) -> DataFrame:
    """New ledger rows for gaps given as (asset_id, symbol, start_time, end_time)."""
    return (
        gaps.where(F.col("start_time") < F.col("end_time"))
        .groupBy(*REPAIR_KEY)
        .agg(F.upper(F.min("symbol")).alias("symbol"))
        .select(
            "asset_id",
            "symbol",
            "start_time",
            "end_time",
            F.lit(PENDING).alias("status"),
            F.lit(0).alias("retry_count"),
            F.lit(max_retries).alias("max_retries"),
            _at(as_of).alias("created_at"),
        )
    )


def active_exact(ledger: DataFrame) -> DataFrame:
    """Windows that an active job already covers exactly."""
    return with_status(ledger, *ACTIVE).select(*REPAIR_KEY)


def schedule_repairs(gaps: DataFrame, ledger: DataFrame, as_of: datetime) -> DataFrame:
    """Ledger rows to append: gaps without an active job for the same asset and window."""
    return repair_jobs(gaps, as_of).join(active_exact(ledger), REPAIR_KEY, "left_anti")


def refresh_jobs(
    windows: DataFrame, as_of: datetime, tier: str | None = None, start: str = "start_time", end: str = "end_time"
) -> DataFrame:
    """Recompute windows widened to the tier (to the day without one), each once."""
    return (
        windows.select(align_start(start, tier).alias("window_start"), align_end(end, tier).alias("window_end"))
        .distinct()
        .withColumn("status", F.lit(PENDING))
        .withColumn("created_at", _at(as_of))
    )


def retry_outcome(ledger: DataFrame, failures: DataFrame) -> DataFrame:
    """Ledger rows with a logged failure, moved to their next state.

    ``failures`` has (id, error_type, error_message), at most one open failure per job.
    """
    log = failures.select(
        "id",
        error_category("error_type", "error_message").alias("error_category"),
        F.concat_ws(": ", "error_type", "error_message").alias("error_message"),
    )
    held = with_status(ledger, PROCESSING).drop("error_category", "error_message")
    return (
        held.join(log, "id")
        .withColumn("status", status_after_failure("error_category", "retry_count", "max_retries"))
        .withColumn("retry_count", F.col("retry_count") + 1)
        .withColumn("lease_expires_at", F.lit(None).cast("timestamp"))
    )


def export_state(exports: DataFrame, as_of: datetime) -> DataFrame:
    """Exports with what a reader gets: ``ready``, ``expired`` or the job's own state."""
    stored = (F.col("status") == COMPLETED) & F.col("s3_key").isNotNull()
    live = F.coalesce(F.col("expires_at") > _at(as_of), F.lit(False))
    state = F.when(stored & live, "ready").when(stored, "expired").otherwise(F.col("status"))
    return exports.withColumn("state", state)
