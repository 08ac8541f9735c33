"""Removing the rows of deleted assets from stored tables, file by file.

Only files that hold such rows are rewritten; all others keep their names and times. The new files are written aside, then the list of the
files they replace: from that moment on the change is made, however often it is begun. They are moved in first and the old ones removed
after, so a reader never misses a row. A run that died is finished by the next one, before anything else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wickmill.operators.assets import orphans, with_known_asset
from wickmill.plans.refresh import base_path, coverage_path, staging_path
from wickmill.plans.repair import repair_ledger
from wickmill.schemas import CANDLE_STORED, COVERAGE_STORED, REPAIR_JOB
from wickmill.sources.ledgers import LOGGED, RUN
from wickmill.sources.tables import drop_files, path_of

# Names that readers of a table pass over.
ASIDE, REPLACED = "_purge", "_replaced"

PART_FOLDERS = ("day", "slot")
LEDGER = StructType([*REPAIR_JOB.fields, LOGGED, RUN])


def stored_tables(root: str) -> dict[str, tuple[str, StructType, tuple[str, ...]]]:
    """Name, path, schema and folders of every table with rows of assets."""
    return {
        "candles": (base_path(root), CANDLE_STORED, PART_FOLDERS),
        "staging": (staging_path(root), CANDLE_STORED, PART_FOLDERS),
        "coverage": (coverage_path(root), COVERAGE_STORED, PART_FOLDERS),
        "repair_jobs": (repair_ledger(root), LEDGER, (RUN.name,)),
    }


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored table; a missing one is empty."""
    files, location = path_of(spark, path)
    return spark.read.schema(schema).parquet(path) if files.exists(location) else spark.createDataFrame([], schema)


def files_with_orphans(spark: SparkSession, path: str, schema: StructType, assets: DataFrame) -> list[str]:
    """Names of the files that hold a row of an unknown asset: one entry per file, from a scan of one column."""
    files, location = path_of(spark, path)
    if not files.exists(location):
        return []
    ids = spark.read.schema(schema).parquet(path).select("asset_id", F.col("_metadata.file_path").alias("file"))
    found = orphans(ids.distinct(), assets).select("file").distinct()
    return sorted(row.file for row in found.toLocalIterator())


def purge_table(spark: SparkSession, path: str, schema: StructType, folders: Sequence[str], assets: DataFrame) -> list[str]:
    """Remove rows of unknown assets from a stored table; returns the names of the files that were replaced."""
    finish_purge(spark, path)
    names = files_with_orphans(spark, path, schema, assets)
    if not names:
        return []
    aside = f"{path}/{ASIDE}"
    held = spark.read.schema(schema).option("basePath", path).parquet(*names)
    with_known_asset(held, assets).select(*schema.fieldNames()).write.mode("overwrite").partitionBy(*folders).parquet(aside)
    files, location = path_of(spark, f"{aside}/{REPLACED}")
    out = files.create(location, True)
    out.write(bytearray("\n".join(names).encode()))
    out.close()
    finish_purge(spark, path)
    return names


def finish_purge(spark: SparkSession, path: str) -> None:
    """Make a decided change complete, and drop one that was not decided."""
    aside = f"{path}/{ASIDE}"
    files, location = path_of(spark, aside)
    if not files.exists(location):
        return
    _, listed = path_of(spark, f"{aside}/{REPLACED}")
    if files.exists(listed):
        # Spark's readers pass over such names, the file system does not.
        stream = files.open(listed)
        names = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        stream.close()
        new = files.listFiles(location, True)
        start = len(location.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()) + 1
        while new.hasNext():
            source = new.next().getPath()
            inner = source.toString()[start:]
            if inner.endswith(".parquet"):
                _, target = path_of(spark, f"{path}/{inner}")
                files.mkdirs(target.getParent())
                files.rename(source, target)
        drop_files(spark, names)
    files.delete(location, True)


def purge_assets(spark: SparkSession, root: str, assets: DataFrame) -> dict[str, list[str]]:
    """Take deleted assets' rows out of candles, staging, coverage and repair jobs; the replaced files by table."""
    return {name: purge_table(spark, *table, assets) for name, table in stored_tables(root).items()}
