"""Fixed schemas of the tables and streams. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_TS = T.TimestampType()
_F64 = T.DoubleType()

OHLCV = ("open", "high", "low", "close", "volume")
CANDLE_COLUMNS = ("asset_id", "timestamp", *OHLCV)

CANDLE = T.StructType(
    [T.StructField("asset_id", T.IntegerType(), False), T.StructField("timestamp", _TS, False)]
    + [T.StructField(name, _F64, False) for name in OHLCV]
)

# On disk the tables carry the UTC day and the slot of the asset as partition columns.
PART_FIELDS = [T.StructField("day", T.DateType(), True), T.StructField("slot", T.IntegerType(), True)]
PART = T.StructType(PART_FIELDS)
TOUCHED = T.StructType([*PART_FIELDS, T.StructField("writer", T.StringType(), True)])
CANDLE_STORED = T.StructType(CANDLE.fields + PART_FIELDS)

EVENT = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("interval", T.StringType()),
        T.StructField("timestamp", _TS),
        T.StructField("close_time", _TS),
        *[T.StructField(name, _F64) for name in OHLCV],
        T.StructField("quote_volume", _F64),
        T.StructField("trade_count", T.LongType()),
        T.StructField("taker_buy_base_volume", _F64),
        T.StructField("taker_buy_quote_volume", _F64),
        T.StructField("is_closed", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_time", _TS),
        T.StructField("received_at", _TS),
    ]
)

ASSET = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("asset_type", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", _TS),
    ]
)

RANGE = T.StructType(
    [
        T.StructField("asset_id", T.IntegerType()),
        T.StructField("start_timestamp", _TS),
        T.StructField("end_timestamp", _TS),
    ]
)

COVERAGE_STORED = T.StructType(RANGE.fields + PART_FIELDS)

REPAIR_JOB = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("asset_id", T.IntegerType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("start_time", _TS),
        T.StructField("end_time", _TS),
        T.StructField("status", T.StringType()),
        T.StructField("retry_count", T.IntegerType()),
        T.StructField("max_retries", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("error_category", T.StringType()),
        T.StructField("lease_expires_at", _TS),
        T.StructField("created_at", _TS),
    ]
)

REFRESH_JOB = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("window_start", _TS),
        T.StructField("window_end", _TS),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("lease_expires_at", _TS),
        T.StructField("created_at", _TS),
    ]
)

# Counters of one micro-batch. On disk by day and, until a day is compacted, by batch.
AUDIT = T.StructType(
    [T.StructField("day", T.DateType()), T.StructField("batch_id", T.LongType())]
    + [
        T.StructField(name, T.LongType())
        for name in ("batches", "received", "rejected", "unmapped", "inactive", "duplicate", "persisted")
    ]
)
