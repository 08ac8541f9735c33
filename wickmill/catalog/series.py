"""Metric series and dead-letter reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickmill.catalog import inputs as I
from wickmill.catalog.registry import query
from wickmill.operators.messages import message_report, message_totals
from wickmill.operators.series import growth_rate, sustained_alerts

# Alert rules over the event series, in the shape of the fixed rules.
_RULES = (
    ("ErrorHigh", "error", 10.0, 5),
    ("ErrorVeryHigh", "error", 40.0, 5),
    ("PurchaseHigh", "purchase", 10.0, 15),
    ("ViewAny", "view", 0.0, 15),
)
_RULES_SQL = "(VALUES " + ", ".join(f"('{a}', '{m}', {t}, {n})" for a, m, t, n in _RULES) + ") r(alert, metric, threshold, for_minutes)"


def samples(spark, sf_dir):
    return I.events(spark, sf_dir).select(F.col("event_type").alias("metric"), "ts", "value")


@query(
    "sustained_alert",
    f"""
    SELECT alert, metric, for_minutes, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS samples
    FROM (SELECT *, sum(CASE WHEN holds THEN 0 ELSE 1 END) OVER (PARTITION BY alert ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run
          FROM (SELECT r.*, e.ts, e.value > r.threshold AS holds
                FROM events e JOIN {_RULES_SQL} ON r.metric = e.event_type))
    WHERE holds GROUP BY alert, metric, for_minutes, run
    HAVING max(ts) - min(ts) >= to_minutes(for_minutes)
    """,
)
def sustained_alert(spark, sf_dir):
    return sustained_alerts(samples(spark, sf_dir), _RULES)


@query(
    "growth_rate",
    """
    SELECT event_type AS metric, ts, value,
           CASE WHEN first_ts < ts THEN (value - first_value) / ((epoch_us(ts) - epoch_us(first_ts)) / 1000000.0 / 60.0)
           END AS growth_per_minute
    FROM (SELECT event_type, ts, value, first_value(ts) OVER w AS first_ts, first_value(value) OVER w AS first_value
          FROM events
          WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW))
    """,
)
def growth(spark, sf_dir):
    return growth_rate(samples(spark, sf_dir))


_NOW = I.utc(2024, 1, 31)
_AGE = "(epoch_us(TIMESTAMP '2024-01-31') - epoch_us(date_trunc('millisecond', min(CASE WHEN {ok} THEN ts END)))) / 1000000.0"


def dead_letters(spark, sf_dir):
    """One dead-letter message per event; low values lack the actor or are broken text."""
    stamp = F.concat(F.lit('"message_timestamp":'), F.unix_millis("ts").cast("string"), F.lit("}"))
    named = F.concat(F.lit('{"actor_name":"'), F.col("event_type"), F.lit('",'), stamp)
    text = F.when(F.col("value") < 1, "{broken").when(F.col("value") < 2, F.concat(F.lit("{"), stamp)).otherwise(named)
    return I.events(spark, sf_dir).select(text.alias("value"))


@query(
    "message_report",
    f"""SELECT CASE WHEN value < 1 THEN NULL WHEN value < 2 THEN 'unknown' ELSE event_type END AS actor_name,
               count(*) AS messages, {_AGE.format(ok="value >= 1")} AS oldest_age_seconds
        FROM events GROUP BY 1""",
)
def message_counts(spark, sf_dir):
    return message_report(dead_letters(spark, sf_dir), _NOW)


@query(
    "message_totals",
    f"SELECT count(*) AS messages, {_AGE.format(ok='value >= 1')} AS oldest_age_seconds FROM events",
)
def message_total(spark, sf_dir):
    return message_totals(dead_letters(spark, sf_dir), _NOW)
