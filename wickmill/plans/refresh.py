"""Recompute the tiers of changed parts, and merge staged rows into the base table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from wickmill.operators.coverage import day_ranges, merge_ranges
from wickmill.operators.rollup import all_tiers, touched_days
from wickmill.schemas import CANDLE_STORED, COVERAGE_STORED, TOUCHED
from wickmill.sources.tables import (
    Part,
    all_parts,
    append_absent,
    clustered,
    drop_files,
    drop_parts,
    first_written,
    parts_of,
    path_of,
    read_candles,
    read_days,
    read_parts,
    stored_days,
    stored_parts,
    take_files,
    with_part,
)
from wickmill.timeframes import BASE_TIER, ROLLUP_TIERS, tier_path


def base_path(root: str) -> str:
    return tier_path(root, BASE_TIER)


def staging_path(root: str) -> str:
    return f"{root.rstrip('/')}/staging"


def coverage_path(root: str) -> str:
    return f"{root.rstrip('/')}/coverage"


def refresh_parts(spark: SparkSession, root: str, touched: Iterable[Part | date]) -> None:
    """Rebuild all five tiers of the touched parts, and nothing else; a plain day stands for all its slots.

    Every bucket of every tier lies inside one part, so a part's tiers depend on that part's base
    rows only. One job writes the five tiers; parts that lost their last base row lose their tiers.
    """
    parts = all_parts(spark, touched)
    if not parts:
        return
    base = read_candles(spark, base_path(root), parts=parts)
    (
        clustered(all_tiers(base), "tier")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("tier", "day", "slot")
        .parquet(root)
    )
    emptied = set(parts).difference(stored_parts(spark, base_path(root), parts))
    for tier in ROLLUP_TIERS:
        drop_parts(spark, tier_path(root, tier), emptied)


def refresh_days(spark: SparkSession, root: str, days: Sequence[date]) -> None:
    """Rebuild all five tiers of whole days."""
    refresh_parts(spark, root, days)


def days_of_windows(windows: DataFrame) -> list[date]:
    """Distinct days of recompute windows, so windows that repeat a day cost one rebuild."""
    return [row.day for row in touched_days(windows).collect()]


def refresh_windows(spark: SparkSession, root: str, windows: DataFrame) -> list[date]:
    """Rebuild the tiers for every (window_start, window_end) of a ledger."""
    days = days_of_windows(windows)
    refresh_days(spark, root, days)
    return days


def merge_staged(spark: SparkSession, root: str, days_per_job: int = 366) -> list[Part]:
    """Move staged rows into the base table, base rows winning; returns the parts to refresh.

    Staged rows whose key the base has not are appended; no base file is touched. Of copies the one staged first is taken. Exactly the
    files that were read are removed, so what another writer stages meanwhile stays for the next merge. A crash between the append and
    the removal is harmless: merging the same rows again adds nothing.
    """
    days = stored_days(spark, staging_path(root))
    parts: list[Part] = []
    for first in range(0, len(days), days_per_job):
        here = stored_parts(spark, staging_path(root), all_parts(spark, days[first : first + days_per_job]))
        if not here:
            continue
        staged = read_parts(spark, staging_path(root), CANDLE_STORED, here)
        append_absent(spark, first_written(staged), base_path(root), here)
        drop_files(spark, take_files(spark, staged))
        parts += here
    return parts


def refresh_coverage(spark: SparkSession, root: str, touched: Iterable[Part | date]) -> None:
    """Rebuild the covered ranges inside the touched parts from base and staged candles.

    Ranges are stored cut at midnight, so a late candle touches its own part only; readers join the
    cuts with :func:`read_coverage`.
    """
    parts = all_parts(spark, touched)
    if not parts:
        return
    held = read_candles(spark, base_path(root), parts=parts).unionByName(
        read_candles(spark, staging_path(root), parts=parts)
    )
    (
        with_part(day_ranges(held), "start_timestamp")
        .hint("rebalance", "day", "slot")
        .sortWithinPartitions("day", "slot", "asset_id", "start_timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "slot")
        .parquet(coverage_path(root))
    )
    held_parts = {p for path in (base_path(root), staging_path(root)) for p in stored_parts(spark, path, parts)}
    drop_parts(spark, coverage_path(root), set(parts) - held_parts)


# -- refresh as a job of its own -----------------------------------------------------------------------------------


def touched_path(root: str) -> str:
    return f"{root.rstrip('/')}/touched"


def note_touched(spark: SparkSession, root: str, parts: Sequence[Part], writer: str) -> None:
    """Note parts that await their refresh. A writer that runs again replaces its own note."""
    if parts:
        rows = spark.createDataFrame([(part.day, part.slot, writer) for part in parts], TOUCHED)
        (
            rows.coalesce(1)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("writer")
            .parquet(touched_path(root))
        )


def refresh_touched(spark: SparkSession, root: str) -> list[Part]:
    """Merge what is staged, and rebuild tiers and coverage of all parts noted since the last run, each once.

    Writers only append and leave notes; this is the job that a schedule runs. Notes are removed by name after the rebuild: a note written
    meanwhile waits for the next run, and a run that dies is done again.
    """
    merged = merge_staged(spark, root)
    files, location = path_of(spark, touched_path(root))
    notes = spark.read.schema(TOUCHED).parquet(touched_path(root)) if files.exists(location) else None
    noted = parts_of(notes) if notes is not None else []
    parts = sorted({*merged, *noted})
    refresh_parts(spark, root, parts)
    refresh_coverage(spark, root, parts)
    if notes is not None:
        drop_files(spark, take_files(spark, notes))
    return parts


def read_coverage(spark: SparkSession, root: str, asset_id: int | None = None) -> DataFrame:
    """Covered ranges of every asset, or of one in start order."""
    pieces = read_days(spark, coverage_path(root), COVERAGE_STORED).drop("day", "slot")
    if asset_id is None:
        return merge_ranges(pieces)
    return merge_ranges(pieces.where(pieces.asset_id == asset_id)).orderBy("start_timestamp")
