"""Metric series: conditions that hold for a while, and growth over a trailing window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickmill.functions.time import seconds_between
from wickmill.operators.ordered import CHUNK, CHUNK_ROWS, join_across_chunks, least_ahead, up_to, with_bounded_chunk

# Alert name, metric, threshold the value must exceed, minutes it must hold.
ALERT_RULES = (
    ("DeadLetterQueueWarning", "dlq_job_count", 0.0, 5),
    ("DeadLetterQueueCritical", "dlq_job_count", 10.0, 5),
    ("DeadLetterQueueRot", "dlq_oldest_job_age_seconds", 3600.0, 5),
    ("CaggRefreshFailed", "cagg_refresh_failed_jobs", 0.0, 5),
    ("CaggRefreshQueueBuildup", "cagg_refresh_pending_jobs", 50.0, 15),
)
GROWTH_WINDOW_SECONDS = 300

SLICE_SECONDS = 3600


def with_rules(samples: DataFrame, rules: Sequence[tuple] = ALERT_RULES) -> DataFrame:
    """Each sample once per rule on its metric.

    The rules are a short fixed list, so they are written into the plan as one array per metric: no
    join, and no exchange that would gather a busy metric.
    """
    of_metric = F.lit(None)
    for metric in sorted({rule[1] for rule in rules}):
        structs = [
            F.struct(F.lit(alert).alias("alert"), F.lit(float(limit)).alias("threshold"), F.lit(int(minutes)).alias("for_minutes"))
            for alert, name, limit, minutes in rules
            if name == metric
        ]
        of_metric = F.when(F.col("metric") == metric, F.array(*structs)).otherwise(of_metric)
    return samples.select("*", F.inline(of_metric))


def sustained_alerts(samples: DataFrame, rules: Sequence[tuple] = ALERT_RULES, rows: int = CHUNK_ROWS) -> DataFrame:
    """Stretches of samples (metric, ts, value) above a rule's threshold for at least its minutes.

    Runs of equal state are cut per hour, and within an hour of more than ``rows`` samples by their number; the first and
    last run of a slice are then joined across slices, so neither a long nor a dense series meets in one task.
    """
    keys = ["alert", "metric"]
    watched = samples.where(F.col("metric").isin(sorted({rule[1] for rule in rules})))
    state = with_rules(with_bounded_chunk(watched, ["metric"], "ts", SLICE_SECONDS, rows), rules).withColumn(
        "holds", F.col("value") > F.col("threshold")
    )
    window = Window.partitionBy(*keys, CHUNK).orderBy("ts")
    changed = ~F.col("holds").eqNullSafe(F.lag("holds").over(window))
    runs = (
        state.withColumn("_new", F.when(changed, 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(up_to(window)))
        .groupBy(*keys, CHUNK, "_run")
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("ended_at"),
            F.count("*").alias("samples"),
            F.max("holds").alias("holds"),
            F.max("for_minutes").alias("for_minutes"),
        )
    )
    in_slice = Window.partitionBy(*keys, CHUNK).orderBy("started_at")
    placed = runs.withColumn("_first", F.col("_run") == 1).withColumn(
        "_last", F.lead("_run").over(in_slice).isNull()
    )

    def starts_new(group):
        follows = F.col("_first") & F.lag("_last").over(group) & (F.col(CHUNK) != F.lag(CHUNK).over(group))
        return ~F.coalesce(follows & (F.col("holds") == F.lag("holds").over(group)), F.lit(False))

    merged = join_across_chunks(
        placed,
        keys,
        "started_at",
        "ended_at",
        at_edge=F.col("_first") | F.col("_last"),
        starts_new=starts_new,
        extra={
            "samples": F.sum("samples"),
            "holds": F.max("holds"),
            "for_minutes": F.max("for_minutes"),
        },
    )
    long_enough = seconds_between("started_at", "ended_at") >= F.col("for_minutes") * 60
    return merged.where(F.col("holds") & long_enough).drop("holds")


def growth_rate(samples: DataFrame, window_seconds: int = GROWTH_WINDOW_SECONDS, rows: int = CHUNK_ROWS) -> DataFrame:
    """Change per minute between the oldest and newest sample of a trailing window.

    Each sample asks for the first sample at or after the window's start. Questions and samples are ordered together in
    slices of an hour, or of ``rows`` rows where an hour holds more; a question that its slice cannot answer takes the first
    sample of a later one. So no sample is copied into other slices, however dense the series. Of samples of one time
    the least value counts as the oldest. Null where the window holds a single time; samples without a time are left out.
    """
    sample = F.struct("ts", "value")
    start = F.timestamp_micros(F.unix_micros("ts") - window_seconds * 1_000_000)
    roles = F.array(
        F.struct(F.col("ts").alias("_at"), sample.alias("_sample")),
        F.struct(start.alias("_at"), F.when(F.lit(False), sample).alias("_sample")),
    )
    both = samples.where(F.col("ts").isNotNull()).select("*", F.inline(roles))
    chunked = with_bounded_chunk(both, ["metric"], "_at", SLICE_SECONDS, rows)
    first_ts, first_value = F.col("_first.ts"), F.col("_first.value")
    minutes = seconds_between(first_ts, "ts") / F.lit(60.0)
    return (
        least_ahead(chunked, ["metric"], "_at", F.col("_sample"), "_first")
        .where(F.col("_sample").isNull())
        .select(*samples.columns, F.when(first_ts < F.col("ts"), (F.col("value") - first_value) / minutes).alias("growth_per_minute"))
    )
