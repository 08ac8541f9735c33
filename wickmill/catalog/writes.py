"""First-write-wins, staging, day merge and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wickmill.catalog import inputs as I
from wickmill.catalog.registry import query
from wickmill.operators import dedup as D
from wickmill.operators.rollup import touched_days
from wickmill.plans.refresh import base_path, merge_staged, refresh_days, refresh_windows, staging_path
from wickmill.plans.repair import write_by_age
from wickmill.session import scratch_dir
from wickmill.sources.tables import insert_ignore, read_candles, stored_days, write_candles
from wickmill.timeframes import ROLLUP_TIERS, tier_path

_CANDLE = 'asset_id, "timestamp", open, high, low, close, volume'


def _first(source: str) -> str:
    return f"SELECT {_CANDLE} FROM ({I.first_rows_sql(source)})"


def _union_sql(winner: str, other: str) -> str:
    """Rows of the winner, and those of the other whose key the winner lacks."""
    return f"""
        SELECT * FROM ({_first(winner)})
        UNION ALL
        SELECT o.* FROM ({_first(other)}) o ANTI JOIN ({_first(winner)}) w
        ON w.asset_id = o.asset_id AND w."timestamp" = o."timestamp\""""


def _unique(df):
    return D.candle_columns(D.dedup_first(df))


@query("dedup_first", I.first_rows_sql(I.FEED_CANDLES))
def dedup_first(spark, sf_dir):
    return D.dedup_first(I.feed_candles(spark, sf_dir))


@query(
    "insert_ignore",
    f"""SELECT o.* FROM ({_first(I.LIVE_FEED)}) o ANTI JOIN ({_first(I.REPAIR_FEED)}) w
        ON w.asset_id = o.asset_id AND w."timestamp" = o."timestamp\"""",
)
def absent(spark, sf_dir):
    return D.absent_rows(_unique(I.live_feed(spark, sf_dir)), _unique(I.repair_feed(spark, sf_dir)))


@query("feed_union", _union_sql(I.LIVE_FEED, I.REPAIR_FEED))
def feed_union(spark, sf_dir):
    return D.feed_union(I.live_feed(spark, sf_dir), I.repair_feed(spark, sf_dir))


@query("merge_union", _union_sql(I.REPAIR_FEED, I.LIVE_FEED))
def merge_union(spark, sf_dir):
    return D.merge_union(_unique(I.repair_feed(spark, sf_dir)), _unique(I.live_feed(spark, sf_dir)))


@query(
    "value_conflicts",
    f"""
    SELECT n.*, s.open AS stored_open, s.high AS stored_high, s.low AS stored_low, s.close AS stored_close,
           s.volume AS stored_volume
    FROM ({_first(I.REPAIR_FEED)}) n JOIN ({_first(I.LIVE_FEED)}) s
      ON s.asset_id = n.asset_id AND s."timestamp" = n."timestamp"
    WHERE (n.open, n.high, n.low, n.close, n.volume) IS DISTINCT FROM (s.open, s.high, s.low, s.close, s.volume)
    """,
)
def value_conflicts(spark, sf_dir):
    return D.value_conflicts(_unique(I.repair_feed(spark, sf_dir)), _unique(I.live_feed(spark, sf_dir)))


_AS_OF = I.utc(2024, 1, 28)


@query(
    "live_hist_split",
    f"""SELECT *, CASE WHEN "timestamp" < TIMESTAMP '2024-01-21' THEN 'staging' ELSE 'base' END AS target
        FROM ({I.USER_CANDLES})""",
)
def live_hist_split(spark, sf_dir):
    return D.with_target(I.user_candles(spark, sf_dir), _AS_OF)


@query(
    "staged_days",
    """SELECT DISTINCT date_trunc('day', ts) AS day FROM events
       WHERE date_trunc('minute', ts) < TIMESTAMP '2024-01-21' ORDER BY day""",
)
def staged_days(spark, sf_dir):
    _, old = D.split_by_age(I.user_candles(spark, sf_dir), _AS_OF)
    return D.staged_days(old).select(F.col("day").cast("timestamp").alias("day"))


@query(
    "touched_days",
    """SELECT DISTINCT unnest(generate_series(date_trunc('day', s), date_trunc('day', e - INTERVAL 1 MICROSECOND),
                                              INTERVAL 1 DAY)) AS day
       FROM (SELECT ts AS s, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS e FROM events) WHERE s < e""",
)
def touched_day_rows(spark, sf_dir):
    minutes = F.floor("value").cast("bigint")
    end = F.timestamp_micros(F.unix_micros("ts") + minutes * 60_000_000)
    windows = I.events(spark, sf_dir).select(F.col("ts").alias("window_start"), end.alias("window_end"))
    return touched_days(windows).select(F.col("day").cast("timestamp").alias("day"))


@query("insert_ignore_sink", _union_sql(I.REPAIR_FEED, I.LIVE_FEED))
def insert_ignore_sink(spark, sf_dir):
    path = scratch_dir(spark, "insert")
    insert_ignore(spark, I.repair_feed(spark, sf_dir), path, arrival="arrival_seq")
    insert_ignore(spark, I.live_feed(spark, sf_dir), path, arrival="arrival_seq")
    return read_candles(spark, path)


@query("insert_ignore_replay", _first(I.FEED_CANDLES))
def insert_ignore_replay(spark, sf_dir):
    path = scratch_dir(spark, "replay")
    for _ in range(2):
        insert_ignore(spark, I.feed_candles(spark, sf_dir), path, arrival="arrival_seq")
    return read_candles(spark, path)


@query("day_merge_sink", _union_sql(I.LIVE_FEED, I.REPAIR_FEED))
def day_merge_sink(spark, sf_dir):
    root = scratch_dir(spark, "merge")
    insert_ignore(spark, I.live_feed(spark, sf_dir), base_path(root), arrival="arrival_seq")
    insert_ignore(spark, I.repair_feed(spark, sf_dir), staging_path(root), arrival="arrival_seq")
    merge_staged(spark, root)
    return read_candles(spark, base_path(root)).unionByName(read_candles(spark, staging_path(root)))


@query(
    "staging_sink",
    f"""SELECT CASE WHEN "timestamp" < TIMESTAMP '2024-01-21' THEN 'staging' ELSE 'base' END AS kept_in, {_CANDLE}
        FROM ({_first(I.FEED_CANDLES)})""",
)
def staging_sink(spark, sf_dir):
    root = scratch_dir(spark, "staging")
    write_by_age(spark, root, I.feed_candles(spark, sf_dir), _AS_OF, "arrival_seq")
    base = read_candles(spark, base_path(root)).withColumn("kept_in", F.lit("base"))
    return base.unionByName(read_candles(spark, staging_path(root)).withColumn("kept_in", F.lit("staging")))


@query("clustered_layout", f"SELECT {_CANDLE} FROM ({I.USER_CANDLES})")
def clustered_layout(spark, sf_dir):
    path = scratch_dir(spark, "layout")
    write_candles(I.user_candles(spark, sf_dir), path)
    return read_candles(spark, path)


@query(
    "candle_scan",
    f"""SELECT {_CANDLE} FROM ({I.USER_CANDLES}) WHERE asset_id = 8
        AND "timestamp" >= TIMESTAMP '2024-01-03 06:30:00' AND "timestamp" < TIMESTAMP '2024-01-25 18:00:00'
        ORDER BY "timestamp\"""",
)
def candle_scan(spark, sf_dir):
    path = scratch_dir(spark, "scan")
    write_candles(I.user_candles(spark, sf_dir), path)
    bounds = I.utc(2024, 1, 3, 6, 30), I.utc(2024, 1, 25, 18)
    return read_candles(spark, path, *bounds, asset_id=8).orderBy("timestamp")


def stored_tiers(spark, root):
    """Every stored tier with its name."""
    parts = [read_candles(spark, tier_path(root, t)).withColumn("tier", F.lit(t)) for t in ROLLUP_TIERS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("tier_sink", I.all_tiers_sql(I.USER_CANDLES))
def tier_sink(spark, sf_dir):
    root = scratch_dir(spark, "tiers")
    write_candles(I.user_candles(spark, sf_dir), base_path(root))
    refresh_days(spark, root, stored_days(spark, base_path(root)))
    return stored_tiers(spark, root)


# Windows to recompute: an hour from each of the highest values.
_TOUCHED = """(SELECT DISTINCT unnest(generate_series(date_trunc('day', ts), date_trunc('day', ts + INTERVAL 3599 SECOND),
                                                      INTERVAL 1 DAY)) FROM events WHERE value > 250)"""


@query(
    "rollup_refresh_window",
    f"""SELECT * FROM ({I.all_tiers_sql(I.USER_CANDLES)})
        WHERE date_trunc('day', "timestamp") IN {_TOUCHED}""",
)
def rollup_refresh_window(spark, sf_dir):
    root = scratch_dir(spark, "refresh")
    write_candles(I.user_candles(spark, sf_dir), base_path(root))
    start = F.timestamp_seconds(F.unix_seconds("ts"))
    windows = (
        I.events(spark, sf_dir)
        .where("value > 250")
        .select(start.alias("window_start"), F.timestamp_seconds(F.unix_seconds("ts") + 3600).alias("window_end"))
    )
    refresh_windows(spark, root, windows)
    return stored_tiers(spark, root)


@query("touched_recompute", I.all_tiers_sql(_union_sql(I.LIVE_FEED, I.REPAIR_FEED)))
def touched_recompute(spark, sf_dir):
    """Tiers of the live feed, then of exactly the days the merged repair feed touched."""
    root = scratch_dir(spark, "touched")
    refresh_days(spark, root, insert_ignore(spark, I.live_feed(spark, sf_dir), base_path(root), arrival="arrival_seq"))
    insert_ignore(spark, I.repair_feed(spark, sf_dir), staging_path(root), arrival="arrival_seq")
    refresh_days(spark, root, merge_staged(spark, root))
    return stored_tiers(spark, root)
