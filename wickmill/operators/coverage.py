"""Covered time ranges of candles: blocks, merged ranges, gaps and their audits.

Ranges are closed on both ends and hold candle open times. A gap is reported as (last covered,
next covered), so both of its ends are already held; ``*_inclusive`` names mark closed ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickmill.functions.time import ceil_to, chunk_of, day_start, seconds_between, shift
from wickmill.operators.intervals import overlapping_pairs, points_in_windows
from wickmill.operators.ordered import (
    CHUNK,
    CHUNK_ROWS,
    before,
    carried_max,
    join_across_chunks,
    running_max,
    up_to,
    with_bounded_chunk,
    with_time_chunk,
)
from wickmill.timeframes import DAY_SECONDS, TIER_SECONDS

# Spacing of base candles and the distance at which two ranges count as touching.
STEP_SECONDS = TIER_SECONDS["1m"]
MARGIN_SECONDS = 60

START = "start_timestamp"
END = "end_timestamp"
KEYS = ("asset_id",)


def _pieces(candles: DataFrame, keys: Sequence[str], time: str, joins: Callable[[Column], Column]) -> DataFrame:
    """Runs of candles where ``joins(micros since the previous candle)`` holds, cut at midnight."""
    chunked = with_time_chunk(candles.select(*keys, time), time)
    window = Window.partitionBy(*keys, CHUNK).orderBy(time)
    micros = F.unix_micros(time)
    joined = F.coalesce(joins(micros - F.lag(micros).over(window)), F.lit(False))
    return (
        chunked.withColumn("_new", F.when(joined, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(up_to(window)))
        .groupBy(*keys, CHUNK, "_run")
        .agg(F.min(time).alias(START), F.max(time).alias(END), F.count("*").alias("candles"))
    )


def _merge_points(
    candles: DataFrame, keys: Sequence[str], time: str, reach_seconds: int, joins: Callable[[Column], Column]
) -> DataFrame:
    """The runs of :func:`_pieces`, joined across midnight."""
    reach = reach_seconds * 1_000_000
    into_chunk = F.unix_micros(START) - F.col(CHUNK) * 1_000_000
    to_chunk_end = (F.col(CHUNK) + DAY_SECONDS) * 1_000_000 - F.unix_micros(END)

    def starts_new(group):
        step = F.unix_micros(START) - F.unix_micros(F.lag(END).over(group))
        return ~F.coalesce(joins(step), F.lit(False))

    return join_across_chunks(
        _pieces(candles, keys, time, joins),
        keys,
        START,
        END,
        at_edge=(into_chunk < reach) | (to_chunk_end <= reach),
        starts_new=starts_new,
        extra={"candles": F.sum("candles")},
    )


def contiguous_blocks(
    candles: DataFrame, keys: Sequence[str] = KEYS, time: str = "timestamp", step_seconds: int = STEP_SECONDS
) -> DataFrame:
    """First and last time of each unbroken run; any other step than exactly one starts a new block.

    Expects one row per (key, time).
    """
    step = step_seconds * 1_000_000
    return _merge_points(candles, keys, time, step_seconds, lambda micros: micros == step)


def coverage_ranges(
    candles: DataFrame, keys: Sequence[str] = KEYS, time: str = "timestamp", margin_seconds: int = MARGIN_SECONDS
) -> DataFrame:
    """Covered ranges of stored candles: blocks no further apart than the margin are one range."""
    margin = margin_seconds * 1_000_000
    return _merge_points(candles, keys, time, margin_seconds, lambda micros: micros <= margin)


def day_ranges(
    candles: DataFrame, keys: Sequence[str] = KEYS, time: str = "timestamp", margin_seconds: int = MARGIN_SECONDS
) -> DataFrame:
    """Covered ranges cut at midnight: what a table of coverage stores per day. Copies are harmless."""
    margin = margin_seconds * 1_000_000
    return _pieces(candles, keys, time, lambda micros: micros <= margin).select(*keys, START, END)


def _folded(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One range per start. Copies are combined map-side, so they never meet in one day's group."""
    return ranges.groupBy(*keys, START).agg(F.max(END).alias(END))


def merge_ranges(ranges: DataFrame, keys: Sequence[str] = KEYS, margin_seconds: int = MARGIN_SECONDS) -> DataFrame:
    """Smallest set of ranges covering the input; overlapping and touching ranges become one."""
    folded = with_time_chunk(_folded(ranges, keys), START)
    window = Window.partitionBy(*keys, CHUNK).orderBy(START)

    def opens(previous_end: Column) -> Column:
        return previous_end.isNull() | (F.col(START) > shift(previous_end, margin_seconds))

    pieces = (
        folded.withColumn("_new", F.when(opens(F.max(END).over(before(window))), 1).otherwise(0))
        .withColumn("_run", F.sum("_new").over(up_to(window)))
        .groupBy(*keys, CHUNK, "_run")
        .agg(F.min(START).alias(START), F.max(END).alias(END))
    )
    # Pieces reached from an earlier day collapse to one per day; with the last piece of the day they
    # are the only ones that can take part in a merge across days.
    reached = (
        pieces.join(carried_max(pieces, keys, F.col(END), "_carry"), [*keys, CHUNK], "left")
        .withColumn("_reached", ~opens(F.col("_carry")))
        .withColumn("_run", F.when(F.col("_reached"), 0).otherwise(F.col("_run")))
        .groupBy(*keys, CHUNK, "_run")
        .agg(F.min(START).alias(START), F.max(END).alias(END), F.max("_reached").alias("_reached"))
        .withColumn("_last", F.lead(START).over(window).isNull())
    )
    return join_across_chunks(
        reached,
        keys,
        START,
        END,
        at_edge=F.col("_reached") | F.col("_last"),
        starts_new=lambda group: opens(F.max(END).over(before(group))),
    )


def add_ranges(existing: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Existing ranges with new ones merged in."""
    columns = [*keys, START, END]
    return merge_ranges(existing.select(*columns).unionByName(new.select(*columns)), keys)


def with_step(candles: DataFrame, keys: Sequence[str] = KEYS, time: str = "timestamp") -> DataFrame:
    """Candles with the previous candle's time and the seconds since it."""
    chunked = with_time_chunk(candles, time)
    return (
        running_max(chunked, keys, [time], F.col(time), "previous_timestamp")
        .withColumn("step_seconds", seconds_between("previous_timestamp", time))
        .drop(CHUNK)
    )


def _with_run_start(df: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column, out: str) -> DataFrame:
    """Time at which each row's run opened: the latest ordering time flagged by ``opens`` so far."""
    return running_max(df, keys, order, F.when(opens, F.col(order[0])), out, inclusive=True)


def with_block_id(
    candles: DataFrame, keys: Sequence[str] = KEYS, time: str = "timestamp", step_seconds: int = STEP_SECONDS
) -> DataFrame:
    """Candles with the start time of their contiguous block, which identifies the block."""
    chunked = with_time_chunk(candles, time)
    stepped = running_max(chunked, keys, [time], F.col(time), "_previous")
    same = F.unix_micros(time) - F.unix_micros("_previous") == step_seconds * 1_000_000
    opens = ~F.coalesce(same, F.lit(False))
    return _with_run_start(stepped, keys, [time], opens, "block_start").drop(CHUNK, "_previous")


def with_island_id(
    ranges: DataFrame, keys: Sequence[str] = KEYS, margin_seconds: int = MARGIN_SECONDS, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Ranges with the start of the merged range they belong to. A day of more than ``rows`` ranges is cut by their number."""
    previous = _previous_end(with_bounded_chunk(ranges, keys, START, rows=rows), keys)
    opens = F.col("previous_end").isNull() | (F.col(START) > shift("previous_end", margin_seconds))
    return _with_run_start(previous, keys, [START, END], opens, "island_start").drop(CHUNK)


def _previous_end(chunked: DataFrame, keys: Sequence[str]) -> DataFrame:
    return running_max(chunked, keys, [START, END], F.col(END), "previous_end")


def with_previous_end(ranges: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Ranges with the latest end among the ranges that start before them."""
    return _previous_end(with_time_chunk(ranges, START), keys).drop(CHUNK)


def overlap_audit(ranges: DataFrame, keys: Sequence[str] = KEYS, rows: int = CHUNK_ROWS) -> DataFrame:
    """Ranges that overlap an earlier range of their key, or occur more than once (closed ends).

    A day of more than ``rows`` different ranges is cut by their number.
    """
    folded = ranges.groupBy(*keys, START, END).agg(F.count("*").alias("copies"))
    overlaps = F.coalesce(F.col(START) <= F.col("previous_end"), F.lit(False))
    previous = _previous_end(with_bounded_chunk(folded, keys, START, rows=rows), keys).drop(CHUNK)
    return previous.where(overlaps | (F.col("copies") > 1))


def inner_gaps(
    ranges: DataFrame,
    keys: Sequence[str] = KEYS,
    margin_seconds: int = MARGIN_SECONDS,
    distinct_starts: bool = False,
) -> DataFrame:
    """Uncovered stretches between the first and last covered time of each key.

    A range opens a stretch when it starts beyond the margin after every earlier end, so the running
    maximum of ends is enough: the ranges need not be merged first. Ranges without a key have no stretches.
    """
    # Said ahead of the windows, so that a later join on the keys adds no filter to one of two equal branches alone.
    keyed = ranges
    for key in keys:
        keyed = keyed.where(F.col(key).isNotNull())
    rows = keyed.select(*keys, START, END) if distinct_starts else _folded(keyed, keys)
    return (
        with_previous_end(rows, keys)
        .where(F.col(START) > shift("previous_end", margin_seconds))
        .select(*keys, F.col("previous_end").alias("gap_start"), F.col(START).alias("gap_end"))
    )


def coverage_gaps(
    ranges: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = KEYS,
    request_start: str = "request_start",
    request_end: str = "request_end",
    distinct_starts: bool = False,
) -> DataFrame:
    """Uncovered stretches of every request, for all keys at once.

    Stretches ahead of and behind a key's coverage come from its first and last covered time; those
    in between from a join of inner gaps and requests that share a day. Ranges one minute apart count
    as joined. ``distinct_starts=True`` says that no two ranges of a key start together (stored
    candles, merged ranges), which saves an exchange.
    """
    wanted = requests.where(F.col(request_start) < F.col(request_end))
    qs, qe = F.col(request_start), F.col(request_end)

    extent = ranges.groupBy(*keys).agg(F.min(START).alias("_first"), F.max(END).alias("_last"))
    outer = F.array(
        F.struct(qs.alias("gap_start"), F.least(F.col("_first"), qe).alias("gap_end")),
        F.struct(F.greatest(F.col("_last"), qs).alias("gap_start"), qe.alias("gap_end")),
    )
    whole = F.array(F.struct(qs.alias("gap_start"), qe.alias("gap_end")))
    ends = (
        wanted.join(extent, list(keys), "left")
        .withColumn("_gap", F.explode(F.when(F.col("_first").isNull(), whole).otherwise(outer)))
        .select(*wanted.columns, "_gap.gap_start", "_gap.gap_end")
    )
    between = (
        overlapping_pairs(
            wanted,
            inner_gaps(ranges, keys, distinct_starts=distinct_starts),
            keys,
            left_span=(request_start, request_end),
            right_span=("gap_start", "gap_end"),
        )
        .withColumn("gap_start", F.greatest("gap_start", request_start))
        .withColumn("gap_end", F.least("gap_end", request_end))
        .select(*wanted.columns, "gap_start", "gap_end")
    )
    return ends.unionByName(between).where(F.col("gap_start") < F.col("gap_end"))


def ranges_in_requests(
    ranges: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = KEYS,
    request_start: str = "request_start",
    request_end: str = "request_end",
) -> DataFrame:
    """Each request with the coverage ranges that touch it (closed on both ends)."""
    return overlapping_pairs(
        requests, ranges, keys, left_span=(request_start, request_end), right_span=(START, END)
    )


def coverage_report(
    candles: DataFrame,
    requests: DataFrame,
    keys: Sequence[str] = KEYS,
    request_start: str = "request_start",
    request_end: str = "request_end",
    step_seconds: int = STEP_SECONDS,
    unique: bool = False,
) -> DataFrame:
    """Distinct candles held against candles expected in each half-open request window.

    Whole days of a window are taken from one count per key and day, so the work does not grow with the candles that
    long or overlapping windows share; only the ragged ends meet single candles. Pass ``unique=True`` for a
    stored table, which already has one row per key and time. Completeness is null where nothing is expected.
    """
    window = [*keys, request_start, request_end]
    times = candles.select(*keys, "timestamp")
    times = times if unique else times.distinct()
    wanted = requests.select(*window).distinct().where(F.col(request_start) < F.col(request_end))
    first_day, last_day = ceil_to(request_start, DAY_SECONDS), day_start(request_end)

    daily = times.groupBy(*keys, chunk_of("timestamp").alias(CHUNK)).agg(F.count("*").alias("candles"))
    step = F.lit(DAY_SECONDS).cast("bigint")
    days = F.when(first_day < last_day, F.sequence(F.unix_seconds(first_day), F.unix_seconds(last_day) - step, step))
    inner = wanted.withColumn(CHUNK, F.explode(days)).join(daily, [*keys, CHUNK]).select(*window, "candles")

    head_end = F.least(first_day, F.col(request_end))
    ends = F.array(
        F.struct(F.col(request_start).alias("_from"), head_end.alias("_to")),
        F.struct(F.greatest(last_day, head_end).alias("_from"), F.col(request_end).alias("_to")),
    )
    edges = points_in_windows(times, wanted.select(*window, F.inline(ends)), keys, "timestamp", "_from", "_to")
    outer = edges.groupBy(*window).agg(F.count("*").alias("candles"))
    held = inner.unionByName(outer).groupBy(*window).agg(F.sum("candles").alias("candles"))
    expected = F.floor(seconds_between(request_start, request_end) / F.lit(step_seconds)).cast("bigint")
    return (
        requests.join(held, window, "left")
        .withColumn("candles", F.coalesce(F.col("candles"), F.lit(0).cast("bigint")))
        .withColumn("expected", expected)
        .withColumn("completeness", F.try_divide("candles", "expected"))
    )
