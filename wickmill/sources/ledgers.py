"""Stored work ledgers: a log of states, appended run by run and folded to the latest state of every job.

States are never updated in place, so writers do not block each other. A run that is repeated replaces its own folder and so adds
nothing. A job's states are ordered by its retries, then by how far the state is, then by the time it was logged.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wickmill.operators.ledger import PENDING, PROCESSING
from wickmill.sources.tables import path_of
from wickmill.timeframes import as_utc

LOGGED = T.StructField("logged_at", T.TimestampType())
RUN = T.StructField("run", T.StringType())


def job_id(*columns: str) -> Column:
    """The same id for the same job on every run."""
    return F.xxhash64(*columns)


def append_states(rows: DataFrame, schema: T.StructType, path: str, run: str, logged_at: datetime) -> None:
    """Log the state of every row of ``rows``; columns of ``schema`` that it lacks are null."""
    columns = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    (
        rows.select(*columns, F.lit(as_utc(logged_at)).alias(LOGGED.name), F.lit(run).alias(RUN.name))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(RUN.name)
        .parquet(path)
    )


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every logged state. A missing ledger is empty."""
    full = T.StructType([*schema.fields, LOGGED, RUN])
    files, location = path_of(spark, path)
    if not files.exists(location):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The latest state of every job."""
    retries = F.col("retry_count") if "retry_count" in schema.fieldNames() else F.lit(0)
    progress = F.when(F.col("status") == PENDING, 0).when(F.col("status") == PROCESSING, 1).otherwise(2)
    order = F.struct(retries, progress, LOGGED.name, RUN.name)
    latest = read_log(spark, path, schema).groupBy("id").agg(F.max_by(F.struct(*schema.fieldNames()), order).alias("_last"))
    return latest.select("_last.*")
