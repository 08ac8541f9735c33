"""Registry lookups, mapping, shards and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.catalog import inputs as I
from wickmill.catalog.registry import query
from wickmill.functions.symbols import normalize_symbol, stream_interval, stream_name, stream_symbol
from wickmill.operators import assets as A
from wickmill.operators.dedup import split_by_age
from wickmill.operators.shards import shard_members, shard_sizes, symbols_of_shard, with_shard
from wickmill.plans.purge import purge_assets, read_table, stored_tables
from wickmill.plans.refresh import base_path, refresh_coverage, staging_path
from wickmill.plans.repair import repair_ledger
from wickmill.schemas import REPAIR_JOB
from wickmill.session import scratch_dir
from wickmill.sources.ledgers import append_states
from wickmill.sources.tables import stored_days, write_candles

_VIEW = "id, symbol, exchange, asset_type, is_active"


@query("asset_scan", f"SELECT * FROM ({I.ASSETS}) WHERE is_active")
def asset_scan(spark, sf_dir):
    return A.active_assets(I.assets(spark, sf_dir))


@query("asset_by_id", f"SELECT {_VIEW} FROM ({I.ASSETS}) WHERE id = 42")
def asset_by_id(spark, sf_dir):
    return A.asset_by_id(I.assets(spark, sf_dir), 42)


@query("asset_by_symbol", f"SELECT {_VIEW} FROM ({I.ASSETS}) WHERE symbol = 'CUSTOMER#000000042' ORDER BY id LIMIT 1")
def asset_by_symbol(spark, sf_dir):
    return A.asset_by_symbol(I.assets(spark, sf_dir), "CUSTOMER#000000042")


@query(
    "asset_filter_page",
    f"""SELECT {_VIEW} FROM ({I.ASSETS}) WHERE is_active AND asset_type = 'MACHINERY'
        ORDER BY id LIMIT 100 OFFSET 20""",
)
def asset_filter_page(spark, sf_dir):
    return A.asset_page(I.assets(spark, sf_dir), asset_type="MACHINERY", offset=20)


@query(
    "asset_exchange_page",
    f"""SELECT {_VIEW} FROM ({I.ASSETS})
        WHERE exchange = (SELECT min(n_name) FROM nation WHERE n_nationkey = 7) ORDER BY id LIMIT 10""",
)
def asset_exchange_page(spark, sf_dir):
    name = I.table(spark, sf_dir, "nation").where("n_nationkey = 7").first().n_name
    return A.asset_page(I.assets(spark, sf_dir), exchange=name, active_only=False, limit=10)


@query("active_symbols", f"SELECT symbol FROM ({I.ASSETS}) WHERE is_active")
def active_symbols(spark, sf_dir):
    return A.active_symbols(I.assets(spark, sf_dir))


@query("symbol_distinct", f"SELECT DISTINCT {I.FEED_SYMBOL} AS symbol FROM events")
def symbol_distinct(spark, sf_dir):
    return A.distinct_symbols(I.feed_events(spark, sf_dir))


@query(
    "normalize_symbol",
    """SELECT c_custkey, upper(c_name) AS symbol, CASE WHEN c_acctbal > 0 THEN 'AB' END AS blank
       FROM customer""",
)
def normalized_symbols(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.lower("c_name"), F.lit(" \n"))
    blank = F.when(F.col("c_acctbal") <= 0, "   ").otherwise(" ab ")
    return I.table(spark, sf_dir, "customer").select(
        "c_custkey", normalize_symbol(padded).alias("symbol"), normalize_symbol(blank).alias("blank")
    )


@query(
    "stream_name",
    """SELECT c_custkey, lower(c_name) || '@kline_1m' AS stream, upper(c_name) AS symbol, '1m' AS "interval"
       FROM customer""",
)
def stream_names(spark, sf_dir):
    named = I.table(spark, sf_dir, "customer").select("c_custkey", stream_name("c_name", F.lit(" 1M ")).alias("stream"))
    return named.select(
        "c_custkey", "stream", stream_symbol("stream").alias("symbol"), stream_interval("stream").alias("interval")
    )


@query(
    "symbol_enrich",
    f"""
    SELECT e.event_id, e.symbol, coalesce(a.id, -1) AS asset_id,
           CASE WHEN a.id IS NULL THEN 'unmapped' WHEN NOT a.is_active THEN 'inactive' END AS map_reject
    FROM (SELECT event_id, {I.FEED_SYMBOL} AS symbol FROM events) e LEFT JOIN ({I.ASSETS}) a USING (symbol)
    """,
)
def symbol_enrich(spark, sf_dir):
    feed = I.events(spark, sf_dir).select("event_id", I.feed_symbol().alias("symbol"))
    return A.enrich_symbols(feed, I.assets(spark, sf_dir)).fillna(-1, ["asset_id"])


_CLOSED = f"(SELECT * FROM ({I.ASSETS}) WHERE is_active)"


@query(
    "asset_exists",
    f"SELECT c.* FROM ({I.USER_CANDLES}) c WHERE asset_id IN (SELECT id FROM {_CLOSED})",
)
def asset_exists(spark, sf_dir):
    return A.with_known_asset(I.user_candles(spark, sf_dir), A.active_assets(I.assets(spark, sf_dir)))


_STAGED = """"timestamp" < TIMESTAMP '2024-01-21'"""
_DAY_RANGES = f"""
    SELECT asset_id, date_trunc('day', "timestamp") AS day, sum(CASE WHEN d <= INTERVAL 1 MINUTE THEN 0 ELSE 1 END) AS ranges
    FROM (SELECT asset_id, "timestamp", "timestamp" - lag("timestamp") OVER (
              PARTITION BY asset_id, date_trunc('day', "timestamp") ORDER BY "timestamp") AS d FROM ({I.USER_CANDLES}))
    GROUP BY ALL"""


def _asset_rows_sql(condition: str) -> str:
    """Rows of each table and asset for which the condition holds."""
    return f"""
        SELECT 'candles' AS table_name, asset_id, count(*) AS "rows" FROM ({I.USER_CANDLES})
        WHERE NOT ({_STAGED}) AND {condition} GROUP BY ALL
        UNION ALL SELECT 'staging', asset_id, count(*) FROM ({I.USER_CANDLES}) WHERE {_STAGED} AND {condition} GROUP BY ALL
        UNION ALL SELECT 'coverage', asset_id, CAST(sum(ranges) AS BIGINT) FROM ({_DAY_RANGES}) WHERE {condition} GROUP BY ALL
        UNION ALL SELECT 'repair_jobs', asset_id, count(*) FROM ({I.JOBS}) WHERE {condition} GROUP BY ALL"""


def _store(spark, sf_dir) -> str:
    """Candles, staging, coverage and a repair ledger as stored tables; returns their root."""
    root = scratch_dir(spark, "assets")
    live, old = split_by_age(I.user_candles(spark, sf_dir), I.utc(2024, 1, 28))
    write_candles(live, base_path(root))
    write_candles(old, staging_path(root))
    refresh_coverage(spark, root, {*stored_days(spark, base_path(root)), *stored_days(spark, staging_path(root))})
    append_states(I.jobs(spark, sf_dir), REPAIR_JOB, repair_ledger(root), "orders", I.utc(2024, 1, 28))
    return root


@query("orphan_audit", _asset_rows_sql(f"asset_id NOT IN (SELECT id FROM {_CLOSED})"))
def orphan_audit(spark, sf_dir):
    """Orphaned rows of all four stored tables."""
    tables = {name: read_table(spark, path, schema) for name, (path, schema, _) in stored_tables(_store(spark, sf_dir)).items()}
    return A.orphan_audit(tables, A.active_assets(I.assets(spark, sf_dir)))


@query("orphan_cascade", _asset_rows_sql(f"asset_id IN (SELECT id FROM {_CLOSED})"))
def orphan_cascade(spark, sf_dir):
    """What all four stored tables hold after the assets' deletion has taken its rows with it."""
    root = _store(spark, sf_dir)
    purge_assets(spark, root, A.active_assets(I.assets(spark, sf_dir)))
    counted = [
        read_table(spark, path, schema).groupBy("asset_id").agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name))
        for name, (path, schema, _) in stored_tables(root).items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query(
    "orphan_purge",
    f"""SELECT id, asset_id, start_time, end_time, status FROM ({I.JOBS})
        WHERE asset_id IN (SELECT id FROM {_CLOSED})""",
)
def orphan_purge(spark, sf_dir):
    columns = ["id", "asset_id", "start_time", "end_time", "status"]
    return A.purge_orphans(I.jobs(spark, sf_dir), A.active_assets(I.assets(spark, sf_dir)), columns)


_SHARD = "CAST(('0x' || substr(sha256(symbol), 1, 16))::UBIGINT % 8 AS INTEGER)"


@query("stable_shard", f"SELECT id, symbol, {_SHARD} AS shard_id FROM ({I.ASSETS})")
def stable_shard(spark, sf_dir):
    return with_shard(I.assets(spark, sf_dir).select("id", "symbol"))


@query(
    "shard_members",
    f"""SELECT CAST(r.shard_id AS INTEGER) AS shard_id, m.symbol FROM range(64) r(shard_id)
        LEFT JOIN (SELECT DISTINCT symbol,
                          CAST(('0x' || substr(sha256(symbol), 1, 16))::UBIGINT % 64 AS INTEGER) AS shard_id
                   FROM (SELECT {I.FEED_SYMBOL} AS symbol FROM events)) m USING (shard_id)""",
)
def shard_member_rows(spark, sf_dir):
    return shard_members(I.feed_events(spark, sf_dir), 64)


@query(
    "shard_sizes",
    f"""SELECT CAST(r.shard_id AS INTEGER) AS shard_id, count(m.symbol) AS symbols FROM range(8) r(shard_id)
        LEFT JOIN (SELECT symbol, {_SHARD} AS shard_id FROM ({I.ASSETS})) m USING (shard_id) GROUP BY ALL""",
)
def shard_size_rows(spark, sf_dir):
    return shard_sizes(I.assets(spark, sf_dir))


@query("shard_filter", f"SELECT DISTINCT symbol FROM ({I.ASSETS}) WHERE {_SHARD} = 3 ORDER BY symbol")
def shard_filter(spark, sf_dir):
    return symbols_of_shard(I.assets(spark, sf_dir), 3)
