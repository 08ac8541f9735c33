"""Session settings the operators rely on, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

INITIAL_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

# Settings that change results or the layout of written tables; safe to set on a live session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # Adaptive execution picks join sides and partition counts from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Tiers are folded in one task after another, each in a table of its own, so a task takes few bytes and there are enough parts to
    # keep it so, whatever the number of shuffle partitions of the session.
    # A session that has more keeps them.
    INITIAL_PARTS: "240",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # A task that reads folds what it reads ahead of the first exchange; well compressed files hold many rows in few bytes.
    "spark.sql.files.maxPartitionBytes": "16m",
    # Beyond 8,000 bytes the Java machine does not compile a method, and a step of many parsed fields becomes one: cut into its operators it runs
    # about half faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    had = [int(spark.conf.get(key, None) or 0) for key in (INITIAL_PARTS, "spark.sql.shuffle.partitions")]
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set(INITIAL_PARTS, str(max(int(RUNTIME_SETTINGS[INITIAL_PARTS]), *had)))
    return spark


def build_session(app_name: str = "wickmill", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session. Sizing (shuffle partitions, memory) stays with the caller."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables written between steps.

    Lives under ``spark.checkpoint.dir`` (the folder all executors share). Only a local session
    without that setting falls back to the machine's own temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/wickmill/{name}-{uuid.uuid4().hex}"
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix=f"spark-{name}-", dir="/tmp")
