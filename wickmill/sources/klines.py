"""Landed kline messages (JSON text) to normalized events.

Keys of a kline differ only by case (``t``/``T``, ``v``/``V``, ``q``/``Q``). The JSON reader keeps them
apart, but a column reference would not, so each parsed struct is cast at once, by position, to
distinct names. Numbers are read as text: a bad one becomes a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wickmill.functions.checks import event_reject_reason
from wickmill.functions.numbers import may_hold_foreign, number, whole_number
from wickmill.functions.once import computed_once
from wickmill.functions.symbols import normalize_symbol
from wickmill.functions.time import from_epoch_ms
from wickmill.schemas import EVENT

# Source label of the feed, interval of a kline that names none, event type of a kline.
DEFAULT_SOURCE = "binance_ws"
DEFAULT_INTERVAL = "1m"
KLINE_EVENT = "kline"

KLINE, CONTROL, MALFORMED = "kline", "control", "malformed"

# Fields of the event object and of its kline object. Name here, key in JSON, Spark type.
EVENT_FIELDS = (("event", "e", "string"), ("event_ms", "E", "string"), ("pair", "s", "string"), ("kline", "k", "string"))
KLINE_FIELDS = (
    ("start_ms", "t", "bigint"),
    ("close_ms", "T", "bigint"),
    ("open", "o", "double"),
    ("high", "h", "double"),
    ("low", "l", "double"),
    ("close", "c", "double"),
    ("volume", "v", "double"),
    ("quote_volume", "q", "double"),
    ("trade_count", "n", "bigint"),
    ("taker_buy_base_volume", "V", "double"),
    ("taker_buy_quote_volume", "Q", "double"),
    ("is_closed", "x", "boolean"),
    ("interval", "i", "string"),
    ("pair", "s", "string"),
)


def _struct(fields, part: int, extra: str = "") -> str:
    """Struct type with the names of this module (part 0) or the JSON keys (part 1), numbers as text."""
    inner = ", ".join(f"{f[part]}: {'boolean' if f[2] == 'boolean' else 'string'}" for f in fields)
    return f"struct<{extra}{inner}>"


def _message(part: int) -> str:
    """An event object, or one wrapped as ``data`` next to ``stream``."""
    return _struct(EVENT_FIELDS, part, f"bad: string, stream: string, data: {_struct(EVENT_FIELDS, part)}, ")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Landed messages, one JSON document per line."""
    return spark.read.text(path)


# Bytes of one micro-batch, so that a first start over a backlog is worked off in bounded batches whatever the sizes of its files.
BYTES_PER_TRIGGER = 256 * 1024 * 1024


def stream_messages(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, bytes_per_trigger: int | None = BYTES_PER_TRIGGER
) -> DataFrame:
    """The same folder as a stream. One micro-batch takes files up to ``bytes_per_trigger``, and at least one; or up to ``files_per_trigger``
    of them where that is given; or, with neither, all that has landed. Spark cuts a large file into tasks as in any read.

    ``landed`` orders the files and their blocks by the time they landed.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    place = ("file_modification_time", "file_path", "file_block_start")
    return reader.load(path).select("value", F.struct(*[f"_metadata.{c}" for c in place]).alias("landed"))


def _is_object(text: Column | str) -> Column:
    bare = F.trim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\r\n"))
    return F.coalesce(bare.startswith("{") & bare.endswith("}"), F.lit(False))


def _has_key(key: str) -> Column:
    """The message has this top-level key, possibly with a JSON null. Exact, but parses the text again:
    the substring test ahead of it keeps that away from ordinary klines."""
    found = F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "variant").isNotNull()
    return F.col("value").contains(f'"{key}"') & found


def with_payload(messages: DataFrame) -> DataFrame:
    """Parse ``value`` and add the event object's fields and ``kind``."""
    parsed = F.from_json("value", _message(1), {"columnNameOfCorruptRecord": "bad"}).cast(_message(0))
    read = computed_once(messages, messages.columns, parsed)
    wrapped = F.col("stream").isNotNull() & F.col("data").isNotNull()
    names = [f[0] for f in EVENT_FIELDS]
    event = F.when(wrapped, F.col("data")).otherwise(F.struct(*names))
    unwrapped = read.select(*messages.columns, "bad", event.alias("_event")).select(
        *messages.columns, "bad", *[F.col(f"_event.{name}").alias(name) for name in names]
    )
    kind = (
        F.when(F.col("bad").isNotNull() | ~_is_object("value"), MALFORMED)
        .when(_has_key("result") & _has_key("id"), CONTROL)
        .when(_has_key("error"), MALFORMED)
        .when(~F.coalesce(F.col("event") == KLINE_EVENT, F.lit(False)), CONTROL)
        .when(~_is_object("kline"), MALFORMED)
        .otherwise(KLINE)
    )
    return unwrapped.withColumn("kind", kind).drop("bad")


def parse_klines(messages: DataFrame, received_at: Column | None = None, source: str = DEFAULT_SOURCE) -> DataFrame:
    """Every message with its event columns, ``kind`` and ``reject_reason``.

    ``kind`` becomes ``malformed`` when a required field is missing, unreadable or breaks an invariant;
    control messages have neither event nor reason. Other input columns are kept.
    """
    kept = messages.columns
    payload = with_payload(messages).select(
        *kept, "kind", "event_ms", F.col("pair").alias("outer_pair"), F.col("kline"), may_hold_foreign(F.col("kline")).alias("suspect")
    )
    kline = F.from_json("kline", _struct(KLINE_FIELDS, 1)).cast(_struct(KLINE_FIELDS, 0))
    fields = computed_once(payload, payload.columns, kline)
    read = {"bigint": whole_number, "double": number}
    numbers = {f[0]: read[f[2]](F.col(f[0]), F.col("suspect")) for f in KLINE_FIELDS if f[2] in read}
    typed = F.struct(
        normalize_symbol(F.coalesce(F.nullif("outer_pair", F.lit("")), F.col("pair"))).alias("symbol"),
        F.coalesce("interval", F.lit(DEFAULT_INTERVAL)).alias("interval"),
        from_epoch_ms(numbers.pop("start_ms")).alias("timestamp"),
        from_epoch_ms(numbers.pop("close_ms")).alias("close_time"),
        *[value.alias(name) for name, value in numbers.items()],
        "is_closed",
        from_epoch_ms(whole_number(F.col("event_ms"), F.lit(True))).alias("event_time"),
    )
    events = computed_once(fields, [*kept, "kind"], typed).select(
        "*",
        F.lit(source).alias("source"),
        (F.current_timestamp() if received_at is None else received_at).alias("received_at"),
    )
    reason = F.when(F.col("kind") == MALFORMED, "not_a_kline").when(
        F.col("kind") == KLINE, event_reject_reason()
    )
    judged = events.withColumn("reject_reason", reason)
    kind = F.when(F.col("reject_reason").isNotNull(), MALFORMED).otherwise(F.col("kind"))
    return judged.select(*kept, kind.alias("kind"), "reject_reason", *EVENT.fieldNames())


def good_events(parsed: DataFrame) -> DataFrame:
    """Normalized events of the readable klines."""
    return parsed.where(F.col("kind") == KLINE).drop("value", "kind", "reject_reason")


def final_events(events: DataFrame) -> DataFrame:
    """Events of finished candles."""
    return events.where("is_closed")


def rejected_messages(parsed: DataFrame) -> DataFrame:
    """Messages to quarantine, with the reason."""
    return parsed.where(F.col("kind") == MALFORMED).select(
        *[c for c in parsed.columns if c not in (*EVENT.fieldNames(), "kind")]
    )
