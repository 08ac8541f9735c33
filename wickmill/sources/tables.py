"""Stored candle tables: Parquet, one folder per UTC day and slot of assets, rows clustered by asset inside it.

A :class:`Part` (day, slot) is what is read, rewritten and refreshed as a whole. An asset lies in slot ``asset_id mod slots``; the number
of slots is the session setting ``wickmill.asset.slots`` and stays the same for the life of a store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from datetime import date, datetime, timedelta
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wickmill.functions.time import day_of
from wickmill.operators.dedup import CANDLE_KEY, absent_rows, dedup_first
from wickmill.schemas import CANDLE_COLUMNS, CANDLE_STORED
from wickmill.timeframes import as_utc


DAY_PREFIX = "day="
SLOT_PREFIX = "slot="

SLOTS_SETTING = "wickmill.asset.slots"
# A few slots suit small tables; a large store sets more, so that a late candle rewrites less.
DEFAULT_SLOTS = 2


class Part(NamedTuple):
    """One UTC day of one slot of assets."""

    day: date
    slot: int


def asset_slots(spark: SparkSession) -> int:
    return int(spark.conf.get(SLOTS_SETTING, str(DEFAULT_SLOTS)))


def slot_of(spark: SparkSession, asset: str = "asset_id") -> Column:
    return F.pmod(F.col(asset), F.lit(asset_slots(spark))).cast("int")


def with_part(candles: DataFrame, time: str = "timestamp") -> DataFrame:
    """Rows with the day and slot they are stored under."""
    return candles.withColumn("day", day_of(time)).withColumn("slot", slot_of(candles.sparkSession))


def parts_of(rows: DataFrame) -> list[Part]:
    """Distinct parts of rows with day and slot: control data, one entry per day and slot at most."""
    return sorted(Part(row.day, row.slot) for row in rows.select("day", "slot").distinct().collect())


def all_parts(spark: SparkSession, touched: Iterable[Part | date]) -> list[Part]:
    """Parts as they are, and every slot of plain days."""
    slots = range(asset_slots(spark))
    found = set()
    for one in touched:
        found.update([one] if isinstance(one, Part) else [Part(one, slot) for slot in slots])
    return sorted(found)


def path_of(spark: SparkSession, path: str):
    """File system and location of a path."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location


def _folders(spark: SparkSession, path: str) -> list[str]:
    files, location = path_of(spark, path)
    if not files.exists(location):
        return []
    return [status.getPath().getName() for status in files.listStatus(location) if status.isDirectory()]


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """Days present in a table, from the names of its folders: one directory listing, no scan."""
    names = _folders(spark, path)
    return sorted(day for n in names if n.startswith(DAY_PREFIX) and (day := _day(n[len(DAY_PREFIX) :])) is not None)


def _day(name: str) -> date | None:
    try:
        return date.fromisoformat(name)
    except ValueError:
        return None


def _day_path(path: str, day: date) -> str:
    return f"{path}/{DAY_PREFIX}{day.isoformat()}"


def part_path(path: str, part: Part) -> str:
    return f"{_day_path(path, part.day)}/{SLOT_PREFIX}{part.slot}"


def stored_parts(spark: SparkSession, path: str, among: Iterable[Part]) -> list[Part]:
    """Those of the given parts that a table has: one directory listing per day."""
    wanted = set(among)
    found = []
    for day in sorted({part.day for part in wanted}):
        slots = [n[len(SLOT_PREFIX) :] for n in _folders(spark, _day_path(path, day)) if n.startswith(SLOT_PREFIX)]
        found += [part for slot in slots if slot.isdigit() and (part := Part(day, int(slot))) in wanted]
    return sorted(found)


def clustered(candles: DataFrame, *leading: str) -> DataFrame:
    """Rows gathered by part and sorted by asset, newest first within an asset.

    A rebalance lets adaptive execution cut a large part into several tasks and join small parts into
    one, so no task holds a whole hot part and no run writes many tiny files. The order inside a file
    makes row-group minima and maxima selective for one asset.
    """
    folders = [*leading, "day", "slot"]
    rows = with_part(candles).hint("rebalance", *folders)
    return rows.sortWithinPartitions(*folders, "asset_id", F.col("timestamp").desc())


def write_candles(candles: DataFrame, path: str, mode: str = "append") -> None:
    """Append rows, or with ``overwrite`` replace exactly the parts that occur in ``candles``."""
    (
        clustered(candles)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", "slot")
        .parquet(path)
    )


def read_days(
    spark: SparkSession, path: str, schema: StructType, wanted: Callable[[date], bool] | None = None
) -> DataFrame:
    """A day-partitioned table, listing only the files of the wanted days. A missing table is empty."""
    present = stored_days(spark, path)
    days = [day for day in present if wanted is None or wanted(day)]
    if not days:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", path)
    if len(days) == len(present):
        return reader.parquet(path)
    return reader.parquet(*[_day_path(path, day) for day in days])


def read_parts(spark: SparkSession, path: str, schema: StructType, parts: Iterable[Part]) -> DataFrame:
    """The given parts of a table, listing only their folders. Missing parts are empty."""
    present = stored_parts(spark, path, parts)
    if not present:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[part_path(path, part) for part in present])


def read_candles(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
    asset_id: int | None = None,
    days: Sequence[date] | None = None,
    parts: Sequence[Part] | None = None,
) -> DataFrame:
    """Scan with the filters that reach storage: day and slot folders, then asset and time in the row groups.

    ``[start, end)`` is half-open. ``parts`` names the folders to read and leaves all others unlisted.
    """
    if parts is not None:
        return read_parts(spark, path, CANDLE_STORED, parts).select(*CANDLE_COLUMNS)
    first = as_utc(start).date() if start is not None else date.min
    last = (as_utc(end) - timedelta(microseconds=1)).date() if end is not None else date.max
    chosen = None if days is None else set(days)
    rows = read_days(
        spark, path, CANDLE_STORED, lambda day: first <= day <= last and (chosen is None or day in chosen)
    )
    if start is not None:
        rows = rows.where((F.col("day") >= F.lit(first)) & (F.col("timestamp") >= F.lit(as_utc(start))))
    if end is not None:
        rows = rows.where((F.col("day") <= F.lit(last)) & (F.col("timestamp") < F.lit(as_utc(end))))
    if asset_id is not None:
        rows = rows.where((F.col("slot") == asset_id % asset_slots(spark)) & (F.col("asset_id") == asset_id))
    return rows.select(*CANDLE_COLUMNS)


def append_absent(spark: SparkSession, unique: DataFrame, path: str, parts: Sequence[Part]) -> None:
    """Append the rows whose key is not stored. ``unique`` has one row per key, all of them in ``parts``."""
    if parts:
        stored = read_candles(spark, path, parts=parts)
        write_candles(absent_rows(unique.select(*CANDLE_COLUMNS), stored), path)


def insert_ignore(spark: SparkSession, new: DataFrame, path: str, arrival: str | None = None) -> list[Part]:
    """Append the rows whose key is not stored; returns the parts that were looked at.

    Only the touched folders are read. Running the same insert again adds nothing, so a retried
    job or a replayed micro-batch is safe.
    """
    unique = dedup_first(new, arrival=arrival).drop(arrival) if arrival else new
    # Read by two jobs; a lost cached block is computed again from its source.
    unique = unique.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = parts_of(with_part(unique))
        append_absent(spark, unique, path, parts)
    finally:
        unique.unpersist()
    return parts


# Order of stored copies: by the time their file was written, then by their place.
WRITTEN = "_written"


def first_written(df: DataFrame) -> DataFrame:
    """One row per candle key of stored rows, the one written first, whatever wrote the others."""
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.row_index")
    return dedup_first(df.select(*CANDLE_COLUMNS, place.alias(WRITTEN)), keys=CANDLE_KEY, arrival=WRITTEN).drop(WRITTEN)


def take_files(spark: SparkSession, df: DataFrame) -> list[str]:
    """Files behind a table as it was listed when ``df`` was made. What is written later is not among them."""
    return df.inputFiles()


def drop_files(spark: SparkSession, names: Sequence[str]) -> None:
    """Remove files by name, and the folders that are empty then."""
    folders = set()
    for name in names:
        files, location = path_of(spark, name)
        files.delete(location, False)
        folders.add(location.getParent().toString())
    for folder in sorted(folders):
        _drop_if_empty(spark, folder, above=2)


def _drop_if_empty(spark: SparkSession, path: str, above: int) -> None:
    """Remove an empty folder of a part or day and look at the one above it."""
    files, location = path_of(spark, path)
    if "=" not in location.getName() or not files.exists(location) or files.listStatus(location):
        return
    # Not recursive: a file that another writer has put there in between stays.
    files.delete(location, False)
    if above > 1:
        _drop_if_empty(spark, location.getParent().toString(), above - 1)


def drop_parts(spark: SparkSession, path: str, parts: Iterable[Part]) -> None:
    """Remove the folders of parts, and of days left without one."""
    for part in stored_parts(spark, path, parts):
        files, location = path_of(spark, part_path(path, part))
        files.delete(location, True)
        _drop_if_empty(spark, location.getParent().toString(), above=1)


def drop_days(spark: SparkSession, path: str, days: Sequence[date]) -> None:
    """Remove day folders."""
    for day in days:
        files, location = path_of(spark, _day_path(path, day))
        files.delete(location, True)
