"""Report over dead-letter messages kept as JSON text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.functions.time import from_epoch_ms, seconds_between
from wickmill.timeframes import as_utc


def _fields(messages: DataFrame) -> DataFrame:
    parsed = F.try_parse_json("value")
    return messages.select(parsed.alias("_json")).select(
        F.col("_json").isNotNull().alias("readable"),
        F.coalesce(F.try_variant_get("_json", "$.actor_name", "string"), F.lit("unknown")).alias("actor_name"),
        from_epoch_ms(F.try_variant_get("_json", "$.message_timestamp", "bigint")).alias("sent_at"),
    )


def message_report(messages: DataFrame, as_of: datetime) -> DataFrame:
    """Exact count and oldest age per actor; unreadable messages are counted under a null actor.

    An actor none of whose messages tells its time has no age.
    """
    actor = F.when(F.col("readable"), F.col("actor_name"))
    age = seconds_between(F.min("sent_at"), F.lit(as_utc(as_of)))
    return (
        _fields(messages)
        .groupBy(actor.alias("actor_name"))
        .agg(F.count("*").alias("messages"), F.when(age.isNotNull(), F.greatest(age, F.lit(0.0))).alias("oldest_age_seconds"))
    )


def message_totals(messages: DataFrame, as_of: datetime) -> DataFrame:
    """Total number of messages and the age of the oldest."""
    age = seconds_between(F.min("sent_at"), F.lit(as_utc(as_of)))
    return _fields(messages).agg(
        F.count("*").alias("messages"),
        F.coalesce(F.greatest(age, F.lit(0.0)), F.lit(0.0)).alias("oldest_age_seconds"),
    )
