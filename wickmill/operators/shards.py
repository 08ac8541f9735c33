"""Symbols per shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.functions.symbols import normalize_symbol, shard_of

# Fixed value: number of shards when none is given.
DEFAULT_SHARDS = 8


def with_shard(symbols: DataFrame, shards: int = DEFAULT_SHARDS) -> DataFrame:
    """Add the shard number of each row's symbol."""
    return symbols.withColumn("shard_id", shard_of("symbol", shards))


def shard_members(symbols: DataFrame, shards: int = DEFAULT_SHARDS) -> DataFrame:
    """One row per (shard, distinct symbol); a shard without symbols keeps one row with a null symbol.

    Long form rather than one list per shard, so a shard may hold any number of symbols.
    """
    members = (
        symbols.select(normalize_symbol("symbol").alias("symbol"))
        .where("symbol is not null")
        .distinct()
        .withColumn("shard_id", shard_of("symbol", shards))
    )
    every = symbols.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard_id"))
    return every.join(members, "shard_id", "left").select("shard_id", "symbol")


def shard_sizes(symbols: DataFrame, shards: int = DEFAULT_SHARDS) -> DataFrame:
    """Distinct symbols per shard, zero included."""
    return shard_members(symbols, shards).groupBy("shard_id").agg(F.count("symbol").alias("symbols"))


def symbols_of_shard(symbols: DataFrame, shard_id: int, shards: int = DEFAULT_SHARDS) -> DataFrame:
    """Sorted distinct symbols of one shard."""
    if not 0 <= shard_id < shards:
        raise ValueError(f"shard_id {shard_id} is outside 0..{shards - 1}")
    return (
        symbols.select(normalize_symbol("symbol").alias("symbol"))
        .where("symbol is not null")
        .where(shard_of("symbol", shards) == shard_id)
        .distinct()
        .orderBy("symbol")
    )
