"""Symbol text and the stable shard number of a symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: separator between symbol and interval in a stream name.
STREAM_INFIX = "@kline_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_symbol(symbol: Column | str) -> Column:
    """Trimmed upper-case symbol; blank text becomes null, which callers treat as a reject."""
    return F.nullif(F.upper(F.regexp_replace(_col(symbol), r"^\s+|\s+$", "")), F.lit(""))


def stream_name(symbol: Column | str, interval: Column | str) -> Column:
    """Name of a kline stream, for example ``btcusdt@kline_1m``."""
    return F.concat(F.lower(normalize_symbol(symbol)), F.lit(STREAM_INFIX), F.lower(F.trim(_col(interval))))


def stream_symbol(name: Column | str) -> Column:
    """Symbol inside a stream name."""
    return normalize_symbol(F.split_part(_col(name), F.lit(STREAM_INFIX), F.lit(1)))


def stream_interval(name: Column | str) -> Column:
    """Interval inside a stream name."""
    return F.split_part(_col(name), F.lit(STREAM_INFIX), F.lit(2))


def shard_of(symbol: Column | str, shards: int) -> Column:
    """SHA-256 of the normalized symbol, first 8 bytes as an unsigned big-endian number, modulo ``shards``."""
    if shards <= 0:
        raise ValueError("shards must be positive")
    digest = F.sha2(normalize_symbol(symbol), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (number % F.lit(shards)).cast("int")
