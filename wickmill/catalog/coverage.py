"""Blocks, ranges, gaps and order checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickmill.catalog import inputs as I
from wickmill.catalog.registry import query
from wickmill.functions.time import day_start, floor_to
from wickmill.operators import coverage as C
from wickmill.operators.ingest import ordered_pages, page_order


def _blocks_sql(source: str, step: str, relation: str = "=") -> str:
    """Runs of times whose distance to the previous one stands in ``relation`` to the step."""
    return f"""
        SELECT asset_id, min("timestamp") AS start_timestamp, max("timestamp") AS end_timestamp,
               count(*) AS candles
        FROM (
            SELECT *, sum(CASE WHEN d {relation} INTERVAL '{step}' THEN 0 ELSE 1 END) OVER (
                       PARTITION BY asset_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS block
            FROM (SELECT asset_id, "timestamp",
                         "timestamp" - lag("timestamp") OVER (PARTITION BY asset_id ORDER BY "timestamp") AS d
                  FROM ({source}))
        ) GROUP BY asset_id, block"""


@query("contiguous_blocks", _blocks_sql(I.TYPE_CANDLES, "1 minute"))
def contiguous_blocks(spark, sf_dir):
    return C.contiguous_blocks(I.type_candles(spark, sf_dir))


@query("contiguous_blocks_hourly", _blocks_sql(I.HOUR_CANDLES, "1 hour"))
def contiguous_blocks_hourly(spark, sf_dir):
    return C.contiguous_blocks(I.hour_candles(spark, sf_dir), step_seconds=3600)


@query("coverage_ranges", _blocks_sql(I.TYPE_CANDLES, "1 minute", "<="))
def coverage_ranges(spark, sf_dir):
    return C.coverage_ranges(I.type_candles(spark, sf_dir))


@query(
    "step_delta",
    f"""
    SELECT asset_id, "timestamp", lag("timestamp") OVER w AS previous_timestamp,
           CAST(date_diff('second', lag("timestamp") OVER w, "timestamp") AS DOUBLE) AS step_seconds
    FROM ({I.TYPE_CANDLES}) WINDOW w AS (PARTITION BY asset_id ORDER BY "timestamp")
    """,
)
def step_delta(spark, sf_dir):
    return C.with_step(I.type_candles(spark, sf_dir).select("asset_id", "timestamp"))


@query(
    "block_id",
    f"""
    SELECT asset_id, "timestamp",
           max(CASE WHEN d = INTERVAL '1 hour' THEN NULL ELSE "timestamp" END) OVER (
               PARTITION BY asset_id ORDER BY "timestamp" ROWS UNBOUNDED PRECEDING) AS block_start
    FROM (SELECT asset_id, "timestamp",
                 "timestamp" - lag("timestamp") OVER (PARTITION BY asset_id ORDER BY "timestamp") AS d
          FROM ({I.HOUR_CANDLES}))
    """,
)
def block_id(spark, sf_dir):
    hours = I.hour_candles(spark, sf_dir).select("asset_id", "timestamp")
    return C.with_block_id(hours, step_seconds=3600)


@query("merged_ranges", I.MERGED_RANGES)
def merged_ranges(spark, sf_dir):
    return C.merge_ranges(I.user_ranges(spark, sf_dir))


@query(
    "range_update",
    f"""
    SELECT asset_id, min(start_timestamp) AS start_timestamp, max(end_timestamp) AS end_timestamp
    FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY asset_id ORDER BY start_timestamp, end_timestamp
                                   ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, CASE WHEN start_timestamp <= max(end_timestamp) OVER (
                            PARTITION BY asset_id ORDER BY start_timestamp, end_timestamp
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + INTERVAL 1 MINUTE
                        THEN 0 ELSE 1 END AS fresh
              FROM (SELECT * FROM ({I.USER_RANGES})
                    UNION ALL
                    SELECT asset_id, request_start, request_end FROM ({I.USER_REQUESTS})))
    ) GROUP BY asset_id, island
    """,
)
def range_update(spark, sf_dir):
    stored = C.merge_ranges(I.user_ranges(spark, sf_dir))
    new = I.user_requests(spark, sf_dir).select(
        "asset_id", F.col("request_start").alias(C.START), F.col("request_end").alias(C.END)
    )
    return C.add_ranges(stored, new)


@query(
    "island_id",
    f"""
    SELECT asset_id, start_timestamp, end_timestamp, previous_end,
           max(CASE WHEN start_timestamp <= previous_end + INTERVAL 1 MINUTE THEN NULL ELSE start_timestamp END) OVER (
               PARTITION BY asset_id ORDER BY start_timestamp, end_timestamp ROWS UNBOUNDED PRECEDING) AS island_start
    FROM (SELECT *, max(end_timestamp) OVER (PARTITION BY asset_id ORDER BY start_timestamp, end_timestamp
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end
          FROM ({I.USER_RANGES}))
    """,
)
def island_id(spark, sf_dir):
    return C.with_island_id(I.user_ranges(spark, sf_dir))


_GAPS = f"""
    WITH r AS ({I.MERGED_RANGES}), q AS ({I.USER_REQUESTS}),
    points AS (
        SELECT q.*, r.start_timestamp AS s, r.end_timestamp AS e FROM q JOIN r
            ON r.asset_id = q.asset_id AND r.end_timestamp >= request_start AND r.start_timestamp <= request_end
        UNION ALL SELECT *, request_end, request_end FROM q),
    swept AS (
        SELECT *, greatest(request_start, coalesce(max(e) OVER (
                   PARTITION BY asset_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   request_start)) AS pointer
        FROM points)
    SELECT asset_id, request_start, request_end, pointer AS gap_start, s AS gap_end FROM swept WHERE pointer < s"""


@query("gaps", _GAPS)
def gaps(spark, sf_dir):
    return C.coverage_gaps(I.user_ranges(spark, sf_dir), I.user_requests(spark, sf_dir))


@query(
    "range_overlap_audit",
    f"""
    SELECT asset_id, start_timestamp, end_timestamp, copies, previous_end
    FROM (SELECT *, max(end_timestamp) OVER (PARTITION BY asset_id ORDER BY start_timestamp, end_timestamp
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end
          FROM (SELECT asset_id, start_timestamp, end_timestamp, count(*) AS copies
                FROM ({I.USER_RANGES}) GROUP BY ALL))
    WHERE start_timestamp <= previous_end OR copies > 1
    """,
)
def range_overlap_audit(spark, sf_dir):
    return C.overlap_audit(I.user_ranges(spark, sf_dir))


@query(
    "range_request",
    f"""
    SELECT q.asset_id, request_start, request_end, start_timestamp, end_timestamp
    FROM ({I.USER_REQUESTS}) q JOIN ({I.USER_RANGES}) r
      ON r.asset_id = q.asset_id AND end_timestamp >= request_start AND start_timestamp <= request_end
    """,
)
def range_request(spark, sf_dir):
    return C.ranges_in_requests(I.user_ranges(spark, sf_dir), I.user_requests(spark, sf_dir))


@query(
    "range_scan",
    f"SELECT * FROM ({_blocks_sql(I.TYPE_CANDLES, '1 minute', '<=')}) WHERE asset_id = 'click' ORDER BY start_timestamp",
)
def range_scan(spark, sf_dir):
    return C.coverage_ranges(I.type_candles(spark, sf_dir).where("asset_id = 'click'")).orderBy(C.START)


@query(
    "coverage_report",
    f"""
    SELECT q.*, count(c."timestamp") AS candles, CAST(21600 AS BIGINT) AS expected, count(c."timestamp") / 21600 AS completeness
    FROM ({I.USER_REQUESTS}) q LEFT JOIN ({I.USER_CANDLES}) c
      ON c.asset_id = q.asset_id AND c."timestamp" >= request_start AND c."timestamp" < request_end
    GROUP BY ALL
    """,
)
def coverage_report(spark, sf_dir):
    return C.coverage_report(I.user_candles(spark, sf_dir), I.user_requests(spark, sf_dir), unique=True)


_PAGE_ROWS = """
    SELECT event_type AS asset_id, date_trunc('day', ts) AS page_day, event_id AS arrival_seq,
           date_trunc('minute', ts) AS "timestamp" FROM events"""


def _page_rows(spark, sf_dir):
    return I.events(spark, sf_dir).select(
        F.col("event_type").alias("asset_id"),
        day_start("ts").alias("page_day"),
        F.col("event_id").alias("arrival_seq"),
        floor_to("ts", 60).alias("timestamp"),
    )


_PAGES_JUDGED = f"""
    SELECT asset_id, page_day, count(*) AS "rows", coalesce(bool_or("timestamp" <= ahead), false) AS disordered
    FROM (SELECT *, lag("timestamp") OVER (PARTITION BY asset_id, page_day ORDER BY arrival_seq) AS ahead
          FROM ({_PAGE_ROWS})) GROUP BY ALL"""


@query("order_check", _PAGES_JUDGED)
def order_check(spark, sf_dir):
    return page_order(_page_rows(spark, sf_dir), batch=("asset_id", "page_day"))


@query(
    "ordered_pages",
    f"""
    SELECT p.* FROM ({_PAGE_ROWS}) p
    SEMI JOIN (SELECT * FROM ({_PAGES_JUDGED}) WHERE NOT disordered) g
    ON g.asset_id = p.asset_id AND g.page_day = p.page_day
    """,
)
def ordered_page_rows(spark, sf_dir):
    return ordered_pages(_page_rows(spark, sf_dir), batch=("asset_id", "page_day"))
