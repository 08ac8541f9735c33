"""Asset registry: lookups, enrichment of events, integrity audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.functions.symbols import normalize_symbol

ASSET_VIEW = ("id", "symbol", "exchange", "asset_type", "is_active")

# Fixed value: page size when none is asked for.
DEFAULT_PAGE = 100


def active_assets(assets: DataFrame, active_only: bool = True) -> DataFrame:
    return assets.where("is_active") if active_only else assets


def asset_by_id(assets: DataFrame, asset_id: int) -> DataFrame:
    return assets.where(F.col("id") == asset_id).select(*ASSET_VIEW)


def asset_by_symbol(assets: DataFrame, symbol: str, exchange: str | None = None) -> DataFrame:
    """The asset with exactly this symbol; without an exchange, the lowest id among equal symbols."""
    found = assets.where(F.col("symbol") == symbol)
    if exchange is not None:
        found = found.where(F.col("exchange") == exchange)
    return found.orderBy("id").limit(1).select(*ASSET_VIEW)


def asset_page(
    assets: DataFrame,
    exchange: str | None = None,
    asset_type: str | None = None,
    active_only: bool = True,
    limit: int = DEFAULT_PAGE,
    offset: int = 0,
) -> DataFrame:
    """One page of assets in id order; every condition is part of the plan and reaches the scan."""
    found = active_assets(assets, active_only)
    if exchange:
        found = found.where(F.col("exchange") == exchange)
    if asset_type:
        found = found.where(F.col("asset_type") == asset_type)
    return found.orderBy("id").offset(offset).limit(limit).select(*ASSET_VIEW)


def active_symbols(assets: DataFrame) -> DataFrame:
    return assets.where("is_active").select(normalize_symbol("symbol").alias("symbol"))


def distinct_symbols(events: DataFrame) -> DataFrame:
    """Unique normalized symbols of a feed."""
    return events.select(normalize_symbol("symbol").alias("symbol")).where("symbol is not null").distinct()


def symbol_map(assets: DataFrame, exchange: str | None = None) -> DataFrame:
    """One (asset_id, is_active) per normalized symbol, the lowest id where several share it."""
    source = assets if exchange is None else assets.where(F.col("exchange") == exchange)
    return (
        source.withColumn("symbol", normalize_symbol("symbol"))
        .where("symbol is not null")
        .groupBy("symbol")
        .agg(F.min("id").alias("asset_id"), F.min_by("is_active", "id").alias("is_active"))
    )


def enrich_symbols(events: DataFrame, assets: DataFrame, exchange: str | None = None) -> DataFrame:
    """Add ``asset_id`` and ``map_reject`` (``unmapped``, ``inactive`` or null).

    No broadcast hint: the planner broadcasts the registry while it is below the size threshold, and
    beyond that runs a sort-merge join whose hot symbols adaptive execution splits.
    """
    mapped = events.withColumn("symbol", normalize_symbol("symbol")).join(
        symbol_map(assets, exchange), "symbol", "left"
    )
    reject = F.when(F.col("asset_id").isNull(), "unmapped").when(~F.coalesce("is_active", F.lit(False)), "inactive")
    return mapped.withColumn("map_reject", reject).drop("is_active")


def with_known_asset(rows: DataFrame, assets: DataFrame, asset_column: str = "asset_id") -> DataFrame:
    """Rows whose asset exists."""
    return rows.join(assets.select(F.col("id").alias(asset_column)), asset_column, "left_semi")


def orphans(rows: DataFrame, assets: DataFrame, asset_column: str = "asset_id") -> DataFrame:
    """Rows whose asset does not exist: what deleting the asset would have removed."""
    return rows.join(assets.select(F.col("id").alias(asset_column)), asset_column, "left_anti")


def orphan_audit(tables: dict[str, DataFrame], assets: DataFrame) -> DataFrame:
    """Orphaned rows per table and asset."""
    counted = [
        orphans(df.groupBy("asset_id").agg(F.count("*").alias("rows")), assets).select(
            F.lit(name).alias("table_name"), "asset_id", "rows"
        )
        for name, df in tables.items()
    ]
    out = counted[0]
    for part in counted[1:]:
        out = out.unionByName(part)
    return out


def purge_orphans(rows: DataFrame, assets: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The table as it is after deleted assets took their rows with them."""
    kept = with_known_asset(rows, assets)
    return kept.select(*columns) if columns else kept
