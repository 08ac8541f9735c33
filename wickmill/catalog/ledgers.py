"""Ledgers, backfill plans and failure outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickmill.catalog import inputs as I
from wickmill.catalog.registry import query
from wickmill.functions.failures import error_category, is_retryable
from wickmill.operators import ledger as L
from wickmill.plans.backfill import daily_windows, month_plan, page_plan

_AS_OF = I.utc(1998, 7, 1, 12)
_AS_OF_SQL = "TIMESTAMP '1998-07-01 12:00:00'"
_ELIGIBLE = f"(status = 'pending' OR (status = 'processing' AND lease_expires_at < {_AS_OF_SQL}))"
_SHORT = ["id", "status", "created_at"]


@query("job_counts", f"SELECT status, count(*) AS jobs FROM ({I.JOBS}) GROUP BY status")
def job_counts(spark, sf_dir):
    return L.job_counts(I.jobs(spark, sf_dir))


@query("job_eligible", f"SELECT id, status, created_at FROM ({I.JOBS}) WHERE {_ELIGIBLE}")
def job_eligible(spark, sf_dir):
    return L.eligible_jobs(I.jobs(spark, sf_dir), _AS_OF).select(*_SHORT)


@query("oldest_job", f"SELECT id, status, created_at FROM ({I.JOBS}) WHERE {_ELIGIBLE} ORDER BY created_at, id LIMIT 1")
def oldest_job(spark, sf_dir):
    return L.oldest_job(I.jobs(spark, sf_dir), _AS_OF).select(*_SHORT)


@query("status_in", f"SELECT id, status, created_at FROM ({I.JOBS}) WHERE status IN ('pending', 'processing')")
def status_in(spark, sf_dir):
    return L.with_status(I.jobs(spark, sf_dir), *L.ACTIVE).select(*_SHORT)


# Wanted windows: every order's window, widened by a wrong hour for the costliest orders.
_WANTED = """
        SELECT CAST(o_custkey AS INTEGER) AS asset_id, 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS symbol,
               o_orderdate AS start_time,
               o_orderdate + to_hours(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
                                      + CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END) AS end_time
        FROM orders"""


def _wanted(spark, sf_dir):
    start = F.col("o_orderdate").cast("timestamp")
    hours = F.substring("o_orderpriority", 1, 1).cast("int") + F.when(F.col("o_totalprice") > 300000, 1).otherwise(0)
    return I.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("int").alias("asset_id"),
        F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("symbol"),
        start.alias("start_time"),
        F.timestamp_seconds(F.unix_seconds(start) + hours * 3600).alias("end_time"),
    )


_SCHEDULED = f"""
    SELECT asset_id, start_time, end_time, upper(min(symbol)) AS symbol, 'pending' AS status, 0 AS retry_count,
           5 AS max_retries, {_AS_OF_SQL} AS created_at
    FROM ({_WANTED}) w
    WHERE NOT EXISTS (SELECT 1 FROM ({I.JOBS}) j WHERE j.asset_id = w.asset_id AND j.start_time = w.start_time
                      AND j.end_time = w.end_time AND j.status IN ('pending', 'processing'))
    GROUP BY asset_id, start_time, end_time"""


@query("schedule_anti", _SCHEDULED)
def schedule_anti(spark, sf_dir):
    return L.schedule_repairs(_wanted(spark, sf_dir), I.jobs(spark, sf_dir), _AS_OF)


@query(
    "job_active_exact",
    f"SELECT asset_id, start_time, end_time FROM ({I.JOBS}) WHERE status IN ('pending', 'processing')",
)
def job_active_exact(spark, sf_dir):
    return L.active_exact(I.jobs(spark, sf_dir))


@query(
    "ledger_append",
    f"""
    SELECT asset_id, start_time, end_time, status, retry_count FROM ({I.JOBS})
    UNION ALL SELECT asset_id, start_time, end_time, status, retry_count FROM ({_SCHEDULED})
    """,
)
def ledger_append(spark, sf_dir):
    columns = ["asset_id", "start_time", "end_time", "status", "retry_count"]
    ledger = I.jobs(spark, sf_dir)
    fresh = L.schedule_repairs(_wanted(spark, sf_dir), ledger, _AS_OF)
    return ledger.select(*columns).unionByName(fresh.select(*columns))


@query(
    "refresh_windows",
    f"""
    SELECT DISTINCT date_trunc('day', start_time) AS window_start,
           CASE WHEN date_trunc('day', end_time) = end_time THEN end_time
                ELSE date_trunc('day', end_time) + INTERVAL 1 DAY END AS window_end,
           'pending' AS status, {_AS_OF_SQL} AS created_at
    FROM ({_WANTED})
    """,
)
def refresh_windows(spark, sf_dir):
    return L.refresh_jobs(_wanted(spark, sf_dir), _AS_OF)


# A failure log: the kind of failure follows the priority, the text the price band.
_FAILURES = """
        SELECT o_orderkey AS id,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'RateLimitError' WHEN '2' THEN 'APIError'
                    WHEN '3' THEN 'ValueError' WHEN '4' THEN 'sqlalchemy.OperationalError' ELSE 'KeyError' END AS error_type,
               CASE WHEN o_totalprice < 100000 THEN '401 Unauthorized' WHEN o_totalprice < 200000 THEN 'Invalid symbol'
                    ELSE 'server busy' END AS error_message
        FROM orders"""
_CATEGORY = """CASE error_type WHEN 'RateLimitError' THEN 'RATE_LIMITED' WHEN 'ValueError' THEN 'VALIDATION'
        WHEN 'sqlalchemy.OperationalError' THEN 'DATABASE' WHEN 'KeyError' THEN 'TRANSIENT'
        ELSE CASE error_message WHEN '401 Unauthorized' THEN 'AUTHENTICATION' WHEN 'Invalid symbol' THEN 'PERMANENT'
             ELSE 'TRANSIENT' END END"""
_RETRY = f"{_CATEGORY} IN ('RATE_LIMITED', 'NETWORK', 'DATABASE', 'TRANSIENT')"


def _failures(spark, sf_dir):
    digit = F.substring("o_orderpriority", 1, 1)
    kind = (
        F.when(digit == "1", "RateLimitError")
        .when(digit == "2", "APIError")
        .when(digit == "3", "ValueError")
        .when(digit == "4", "sqlalchemy.OperationalError")
        .otherwise("KeyError")
    )
    text = (
        F.when(F.col("o_totalprice") < 100000, "401 Unauthorized")
        .when(F.col("o_totalprice") < 200000, "Invalid symbol")
        .otherwise("server busy")
    )
    return I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), kind.alias("error_type"), text.alias("error_message")
    )


@query("error_class", f"SELECT id, {_CATEGORY} AS error_category, {_RETRY} AS retryable FROM ({_FAILURES})")
def error_class(spark, sf_dir):
    category = error_category("error_type", "error_message")
    return _failures(spark, sf_dir).select("id", category.alias("error_category"), is_retryable(category).alias("retryable"))


@query(
    "retry_outcome",
    f"""
    SELECT id, asset_id, {_CATEGORY} AS error_category, error_type || ': ' || error_message AS error_message,
           CASE WHEN {_RETRY} AND retry_count + 1 <= max_retries THEN 'pending' ELSE 'failed' END AS status,
           retry_count + 1 AS retry_count
    FROM ({I.JOBS}) JOIN ({_FAILURES}) USING (id) WHERE status = 'processing'
    """,
)
def retry_outcome(spark, sf_dir):
    return L.retry_outcome(I.jobs(spark, sf_dir), _failures(spark, sf_dir)).select(
        "id", "asset_id", "error_category", "error_message", "status", "retry_count"
    )


@query(
    "export_live",
    f"""
    SELECT o_orderkey AS id,
           CASE WHEN o_orderstatus = 'F' AND o_orderdate + INTERVAL 1 HOUR > {_AS_OF_SQL} THEN 'ready'
                WHEN o_orderstatus = 'F' THEN 'expired' WHEN o_orderstatus = 'O' THEN 'pending'
                ELSE 'processing' END AS state
    FROM orders
    """,
)
def export_live(spark, sf_dir):
    created = F.col("o_orderdate").cast("timestamp")
    done = F.col("o_orderstatus") == "F"
    exports = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(done, "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing").alias("status"),
        F.when(done, "exports/x.parquet").alias("s3_key"),
        F.when(done, F.timestamp_seconds(F.unix_seconds(created) + 3600)).alias("expires_at"),
    )
    return L.export_state(exports, _AS_OF).select("id", "state")


@query(
    "month_plan",
    f"""
    SELECT id, start_year, m AS window_start, least(m + INTERVAL 1 MONTH, {_AS_OF_SQL}) AS window_end
    FROM (SELECT id, start_year, unnest(generate_series(make_timestamp(start_year, 1, 1, 0, 0, 0), {_AS_OF_SQL},
                                        INTERVAL 1 MONTH)) AS m
          FROM (SELECT c_custkey AS id, 1995 + c_nationkey // 10 AS start_year FROM customer))
    WHERE m < {_AS_OF_SQL}
    """,
)
def month_windows(spark, sf_dir):
    years = (F.lit(1995) + F.floor(F.col("c_nationkey") / 10)).cast("int")
    assets = I.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), years.alias("start_year"))
    return month_plan(assets, _AS_OF)


@query(
    "page_plan",
    """
    SELECT o_orderkey AS id, n AS page_no, o_orderdate + to_minutes(1000 * n) AS page_start,
           least(o_orderdate + to_minutes(1000 * (n + 1)), end_time) AS page_end
    FROM (SELECT *, unnest(generate_series(0, CAST(ceil(minutes / 1000.0) AS BIGINT) - 1)) AS n
          FROM (SELECT o_orderkey, o_orderdate, CAST(floor(o_totalprice / 100) AS BIGINT) AS minutes,
                       o_orderdate + to_minutes(CAST(floor(o_totalprice / 100) AS BIGINT)) AS end_time FROM orders))
    """,
)
def page_windows(spark, sf_dir):
    start = F.col("o_orderdate").cast("timestamp")
    minutes = F.floor(F.col("o_totalprice") / 100).cast("bigint")
    windows = I.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        start.alias("start_time"),
        F.timestamp_seconds(F.unix_seconds(start) + minutes * 60).alias("end_time"),
    )
    return page_plan(windows).select("id", "page_no", "page_start", "page_end")


@query(
    "daily_windows",
    f"""SELECT id AS asset_id, symbol, TIMESTAMP '2024-01-30 07:30:00' AS window_start,
               TIMESTAMP '2024-01-31 07:30:00' AS window_end FROM ({I.ASSETS}) WHERE is_active""",
)
def daily_window_rows(spark, sf_dir):
    return daily_windows(I.assets(spark, sf_dir), I.utc(2024, 1, 31, 7, 30))
