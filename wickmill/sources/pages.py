"""Landed history pages: one JSON array of positional kline arrays per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickmill.functions.checks import candle_reject_reason
from wickmill.functions.numbers import may_hold_foreign, number, whole_number
from wickmill.functions.once import computed_once
from wickmill.functions.time import from_epoch_ms
from wickmill.operators.ingest import page_order
from wickmill.schemas import OHLCV

# Shape of a page and the number of leading elements a kline must have.
PAGE_TYPE = "array<array<string>>"
MIN_ELEMENTS = 6


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed document: ``value`` and its ``page_id`` (the file)."""
    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("page_id"))


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row per kline in arrival order, with ``reject_reason``; a page that is no array gives one row.

    Needs ``value``; other columns (page id, asset) are kept.
    """
    keep = [c for c in pages.columns if c != "value"]
    # What looks at a whole page stands ahead of the generator: behind it, it would be done for every kline, and the text go with each.
    read = pages.select(
        *keep, F.from_json("value", PAGE_TYPE).alias("_rows"), may_hold_foreign(F.col("value")).alias("_suspect")
    ).withColumn("_unreadable", F.col("_rows").isNull())
    exploded = read.select(*keep, "_unreadable", "_suspect", F.posexplode_outer("_rows").alias("arrival_seq", "_k"))
    elements = [F.get("_k", F.lit(i)) for i in range(MIN_ELEMENTS)]
    cells = F.struct(
        F.size("_k").alias("_size"),
        from_epoch_ms(whole_number(elements[0], F.col("_suspect"))).alias("timestamp"),
        *[number(cell, F.col("_suspect")).alias(name) for name, cell in zip(OHLCV, elements[1:])],
    )
    typed = computed_once(exploded, [*keep, "_unreadable", "arrival_seq"], cells)
    reason = F.coalesce(
        F.when(F.col("_unreadable"), "not_a_page"),
        F.when(F.coalesce(F.col("_size"), F.lit(-1)) < MIN_ELEMENTS, "short_kline"),
        candle_reject_reason(),
    )
    # An empty page has no klines: it yields no row at all.
    return (
        typed.where(F.col("_unreadable") | F.col("arrival_seq").isNotNull())
        .withColumn("reject_reason", reason)
        .select(*keep, F.col("arrival_seq").cast("bigint").alias("arrival_seq"), "timestamp", *OHLCV, "reject_reason")
    )


def good_klines(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject_reason is null").drop("reject_reason")


DISORDERED = "disordered"


def judge_pages(parsed: DataFrame, page: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per page of :func:`parse_pages` rows: its number of klines and ``refused``, null for a page to be taken.

    A page is taken or refused whole: one bad kline, or one that is not later than all before it, refuses it. The reason is that of the
    first bad kline.
    """
    first_bad = F.min_by("reject_reason", F.when(F.col("reject_reason").isNotNull(), F.coalesce("arrival_seq", F.lit(-1).cast("bigint"))))
    judged = page_order(parsed, page, first_bad.alias("_bad"))
    return judged.select(
        *page, F.col("rows").alias("klines"), F.coalesce("_bad", F.when(F.col("disordered"), DISORDERED)).alias("refused")
    )


def taken_pages(parsed: DataFrame, judged: DataFrame, page: Sequence[str] = ("page_id",)) -> DataFrame:
    """Rows of the pages that are taken. ``arrival_seq`` orders klines across pages: by page, then by place."""
    good = judged.where("refused is null").select(*page)
    rows = parsed.join(good, list(page), "left_semi").drop("reject_reason")
    return rows.withColumn("arrival_seq", F.struct(*page, "arrival_seq"))
