"""Gap repair for all assets in one set-based job."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickmill.functions.time import day_of, shift
from wickmill.operators.coverage import END, MARGIN_SECONDS, START, coverage_gaps
from wickmill.operators.dedup import dedup_first, split_by_age, with_target
from wickmill.operators.intervals import points_in_windows, overlapping_pairs
from wickmill.operators.ledger import (
    COMPLETED,
    PROCESSING,
    REPAIR_KEY,
    eligible_jobs,
    refresh_jobs,
    retry_outcome,
    schedule_repairs,
)
from wickmill.plans.refresh import base_path, note_touched, refresh_touched, staging_path
from wickmill.schemas import CANDLE_COLUMNS, REFRESH_JOB, REPAIR_JOB
from wickmill.sources.ledgers import append_states, job_id, read_ledger, read_log
from wickmill.sources.pages import judge_pages, parse_pages, taken_pages
from wickmill.sources.tables import Part, append_absent, read_candles, with_part
from wickmill.timeframes import as_utc

# Fixed value: how far back the scan looks.
LOOKBACK = timedelta(hours=24)


def finished_minute(as_of: datetime) -> datetime:
    """The clock floored to the minute, so repeated scans ask for equal windows."""
    return as_utc(as_of).replace(second=0, microsecond=0)


def scan_gaps(held: DataFrame, assets: DataFrame, as_of: datetime, lookback: timedelta = LOOKBACK) -> DataFrame:
    """Uncovered stretches (asset_id, symbol, start_time, end_time) of every active asset.

    ``held`` has the stored candle keys of at least the scanned window. One candle ahead of the
    window is read too, because a range that reaches into the window covers its start.
    """
    end = finished_minute(as_of)
    start = end - lookback
    near = held.where(
        (F.col("timestamp") >= F.lit(start - timedelta(seconds=MARGIN_SECONDS))) & (F.col("timestamp") <= F.lit(end))
    )
    requests = assets.where("is_active").select(
        F.col("id").alias("asset_id"),
        "symbol",
        F.lit(start).alias("request_start"),
        F.lit(end).alias("request_end"),
    )
    # Every stored candle is a range of its own; candles at most a minute apart leave no gap.
    covered = near.select("asset_id", F.col("timestamp").alias(START), F.col("timestamp").alias(END))
    gaps = coverage_gaps(covered, requests)
    return gaps.select(
        "asset_id", "symbol", F.col("gap_start").alias("start_time"), F.col("gap_end").alias("end_time")
    )


def rows_for_gaps(page_rows: DataFrame, gaps: DataFrame) -> DataFrame:
    """Page candles inside the gaps. Both ends belong to a fetch; held ends are ignored on insert."""
    windows = gaps.select("asset_id", "start_time", "end_time").withColumn(
        "_until", F.timestamp_micros(F.unix_micros("end_time") + 1)
    )
    inside = points_in_windows(page_rows, windows, ["asset_id"], "timestamp", "start_time", "_until")
    return inside.select(*page_rows.columns)


@dataclass
class Written:
    """Parts of the base table and of staging that a write looked at."""

    base: list[Part]
    staged: list[Part]
    # Number of unique rows, stored before or not.
    rows: int = 0


def write_by_age(
    spark: SparkSession, root: str, rows: DataFrame, as_of: datetime, arrival: str
) -> Written:
    """First-wins insert of recent rows into the base and of old rows into staging."""
    unique = dedup_first(rows.select(*CANDLE_COLUMNS, arrival), arrival=arrival).drop(arrival)
    # Read by up to three jobs; a lost cached block is computed again from its source.
    unique = unique.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = with_part(with_target(unique, as_of)).groupBy("target", "day", "slot").agg(F.count("*").alias("n")).collect()
        parts = (sorted(Part(r.day, r.slot) for r in found if r.target == t) for t in ("base", "staging"))
        written = Written(*parts, sum(r.n for r in found))
        live, old = split_by_age(unique, as_of)
        append_absent(spark, live, base_path(root), written.base)
        append_absent(spark, old, staging_path(root), written.staged)
    finally:
        unique.unpersist()
    return written


def held_keys(spark: SparkSession, root: str, as_of: datetime, lookback: timedelta) -> DataFrame:
    """Stored and staged candles of the scanned window and the minute ahead of it."""
    end = finished_minute(as_of)
    first, last = end - lookback - timedelta(seconds=MARGIN_SECONDS), end + timedelta(microseconds=1)
    return read_candles(spark, base_path(root), first, last).unionByName(
        read_candles(spark, staging_path(root), first, last)
    )


def repair_gaps(
    spark: SparkSession,
    root: str,
    assets: DataFrame,
    ledger: DataFrame,
    page_rows: DataFrame,
    as_of: datetime,
    lookback: timedelta = LOOKBACK,
    arrival: str = "arrival_seq",
) -> Written:
    """Find gaps, take ready page candles for them, write, merge staging, recompute touched parts.

    ``page_rows`` has (asset_id, arrival_seq, candle columns); gaps whose exact window is an active
    ledger entry are left to that entry. :func:`repair_from_pages` starts from the page texts and keeps the ledger.
    """
    gaps = schedule_repairs(scan_gaps(held_keys(spark, root, as_of, lookback), assets, as_of, lookback), ledger, as_of)
    written = write_by_age(spark, root, rows_for_gaps(page_rows, gaps), as_of, arrival)
    note_touched(spark, root, written.base, f"repair-{as_of:%Y%m%dT%H%M%S%f}")
    refresh_touched(spark, root)
    return written


# -- from page texts -----------------------------------------------------------------------------------------------

PAGE = ("asset_id", "page_id")
# Type under which a refused page fails its job.
REFUSED_TYPE = "PayloadCorruptionError"
# How long a claimed job is left to the run that claimed it.
LEASE = timedelta(minutes=5)


def repair_ledger(root: str) -> str:
    return f"{root.rstrip('/')}/ledger/repairs"


def refresh_ledger(root: str) -> str:
    return f"{root.rstrip('/')}/ledger/refreshes"


def page_quarantine(root: str) -> str:
    return f"{root.rstrip('/')}/quarantine_pages"


def claim_repairs(spark: SparkSession, root: str, gaps: DataFrame, as_of: datetime, run: str) -> DataFrame:
    """Log jobs for gaps without an active one, claim every job that waits or whose lease ran out, and return the claimed ones."""
    path = repair_ledger(root)
    new = schedule_repairs(gaps, read_ledger(spark, path, REPAIR_JOB), as_of)
    named = new.withColumn("id", job_id(*REPAIR_KEY, "created_at"))
    append_states(named, REPAIR_JOB, path, f"{run}-1-scheduled", as_of)
    waiting = eligible_jobs(read_ledger(spark, path, REPAIR_JOB), as_of)
    lease = F.lit(as_utc(as_of) + LEASE)
    claimed = waiting.withColumn("status", F.lit(PROCESSING)).withColumn("lease_expires_at", lease)
    append_states(claimed, REPAIR_JOB, path, f"{run}-2-claimed", as_of)
    # Read back: from here on the run works on stored rows and does not scan for gaps again.
    return read_log(spark, path, REPAIR_JOB).where(F.col("run") == f"{run}-2-claimed").drop("logged_at", "run")


def failed_by_pages(jobs: DataFrame, refused: DataFrame) -> DataFrame:
    """id, error_type, error_message of the jobs for which a page was fetched that is refused; the first such page says why.

    ``refused`` has (asset_id, page_id, page_start, page_end, refused).
    """
    # A page's window is half-open.
    last = F.timestamp_micros(F.unix_micros("page_end") - 1).alias("_page_last")
    pages = refused.select("asset_id", "page_id", "page_start", last, "refused")
    spans = ("start_time", "end_time"), ("page_start", "_page_last")
    met = overlapping_pairs(jobs.select("id", *REPAIR_KEY), pages, ["asset_id"], *spans)
    reason = F.min(F.struct("page_start", "page_id", "refused"))["refused"]
    return met.groupBy("id").agg(F.lit(REFUSED_TYPE).alias("error_type"), reason.alias("error_message"))


def repair_from_pages(
    spark: SparkSession,
    root: str,
    assets: DataFrame,
    pages: DataFrame,
    as_of: datetime,
    run: str,
    lookback: timedelta = LOOKBACK,
) -> DataFrame:
    """Repair all gaps of all active assets from landed page texts, in one set-based run; returns the jobs in their new state.

    ``pages`` has (page_id, asset_id, page_start, page_end, value): the text of a page and the window it was asked for. Steps: scan for gaps,
    log and claim jobs, parse and judge pages (a page is taken or refused whole), quarantine the refused ones, write the candles of taken pages inside
    claimed windows (first write wins), log the outcome of every job and the windows to recompute, recompute touched parts, log that too. Every
    step may run again under the same ``run`` without adding anything.
    """
    gaps = scan_gaps(held_keys(spark, root, as_of, lookback), assets, as_of, lookback)
    jobs = claim_repairs(spark, root, gaps, as_of, run)
    parsed = parse_pages(pages.select(*PAGE, "value")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        judged = judge_pages(parsed, PAGE).persist(StorageLevel.MEMORY_AND_DISK)
        bad = judged.where("refused is not null")
        found = pages.join(bad, list(PAGE)).withColumn("run", F.lit(run))
        (
            found.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run")
            .parquet(page_quarantine(root))
        )
        # Read back, so that what made the page texts is not run again for every state that is logged.
        stored = spark.read.schema(found.schema).parquet(page_quarantine(root)).where(F.col("run") == run)
        refused = stored.drop("run").join(bad.select(*PAGE), list(PAGE), "left_semi")
        written = write_by_age(spark, root, rows_for_gaps(taken_pages(parsed, judged, PAGE), jobs), as_of, "arrival_seq")
        note_touched(spark, root, written.base, run)
        failures = failed_by_pages(jobs, refused)
        failed = retry_outcome(jobs, failures)
        completed = jobs.join(failures, "id", "left_anti").withColumn("status", F.lit(COMPLETED))
        done = completed.withColumn("lease_expires_at", F.lit(None).cast("timestamp"))
        append_states(done.unionByName(failed), REPAIR_JOB, repair_ledger(root), f"{run}-3-done", as_of)
        # Pages of a failed job that were taken are stored too, so the windows of all jobs are recomputed.
        windows = refresh_jobs(jobs, as_of).withColumn("id", job_id("window_start", "window_end", "created_at"))
        append_states(windows, REFRESH_JOB, refresh_ledger(root), f"{run}-1-scheduled", as_of)
        judged.unpersist()
    finally:
        parsed.unpersist()
    refresh_touched(spark, root)
    waiting = read_log(spark, refresh_ledger(root), REFRESH_JOB).where(F.col("run") == f"{run}-1-scheduled")
    append_states(waiting.withColumn("status", F.lit(COMPLETED)), REFRESH_JOB, refresh_ledger(root), f"{run}-2-done", as_of)
    return read_log(spark, repair_ledger(root), REPAIR_JOB).where(F.col("run") == f"{run}-3-done").drop("logged_at", "run")


def with_missing(gaps: DataFrame) -> DataFrame:
    """Gaps with the number of whole candles missing between their held ends."""
    inner_end = shift("end_time", -MARGIN_SECONDS)
    missing = F.floor((F.unix_micros(inner_end) - F.unix_micros("start_time")) / F.lit(MARGIN_SECONDS * 1_000_000))
    return gaps.withColumn("missing", F.greatest(missing, F.lit(0)).cast("bigint"))
