"""Ordered computations per key that never put one key's whole history into one task.

A plain ``Window.partitionBy(key)`` sends every row of a hot key to a single task. Here rows are
windowed per ``(key, chunk)``, where a chunk is a slice of the ordering column (one day, by default).
What must cross a chunk edge is carried by a summary with one row per ``(key, chunk)``; only that
summary is windowed per key, so the largest group is the number of days in a key's history. Where a slice itself can be hot,
``with_bounded_chunk`` cuts it by the rows that it holds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wickmill.functions.once import computed_once
from wickmill.functions.time import chunk_of
from wickmill.timeframes import DAY_SECONDS

CHUNK = "_chunk"
# A slice with more rows is cut further by ``with_bounded_chunk``.
CHUNK_ROWS = 100_000


def with_time_chunk(df: DataFrame, time: str, seconds: int = DAY_SECONDS) -> DataFrame:
    """Add the chunk number of a timestamp column."""
    return df.withColumn(CHUNK, chunk_of(time, seconds))


def with_bounded_chunk(
    df: DataFrame, keys: Sequence[str], time: str, seconds: int = DAY_SECONDS, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add a chunk number whose size follows the rows: slices of more than ``rows`` rows are cut where the rows are.

    Rows are counted per second of the key, map-side. The seconds of a full slice are dealt in order to parts of ``rows`` rows,
    so a part exceeds that by the rows of one second at most. Equal times share a chunk, chunks ascend with time, and the same
    rows always get the same chunks. Only full slices meet the join, on the second, so that a hot slice is spread there too.
    """
    in_slice = Window.partitionBy(*keys, CHUNK)
    counted = df.groupBy(*keys, chunk_of(time, seconds).alias(CHUNK), chunk_of(time, 1).alias("_second")).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(before(in_slice.orderBy("_second"))), F.lit(0))
    parts = (
        counted.withColumn("_all", F.sum("_n").over(in_slice))
        .where(F.col("_all") > rows)
        .withColumn("_part", F.floor(ahead / rows))
        .select(*keys, "_second", F.min("_second").over(Window.partitionBy(*keys, CHUNK, "_part")).alias("_cut"))
    )
    return (
        df.withColumn("_second", chunk_of(time, 1))
        .join(parts, [*keys, "_second"], "left")
        .select(*df.columns, F.coalesce("_cut", chunk_of(time, seconds)).alias(CHUNK))
    )


def before(window: WindowSpec) -> WindowSpec:
    """The rows ahead of the current one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def up_to(window: WindowSpec) -> WindowSpec:
    """The rows ahead of the current one, and the row itself."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carried_max(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """Per (key, chunk): the maximum of ``value`` over all earlier chunks of the key."""
    per_chunk = df.groupBy(*keys, CHUNK).agg(F.max(value).alias("_chunk_max"))
    earlier = before(Window.partitionBy(*keys).orderBy(CHUNK))
    return per_chunk.select(*keys, CHUNK, F.max("_chunk_max").over(earlier).alias(out))


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    out: str,
    inclusive: bool = False,
) -> DataFrame:
    """Running maximum of ``value`` along ``order`` for each key; needs the chunk column.

    ``inclusive`` counts the row itself; otherwise only the rows before it.
    """
    window = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = df.withColumn("_upto", F.max(value).over(up_to(window)))
    local = F.col("_upto") if inclusive else F.max(value).over(before(window))
    # The last row of a chunk knows the chunk's maximum. Looking for a next row with all columns makes this branch ask for the
    # same exchange as the rows themselves, and filters on join keys are not pushed through a generator: it runs once.
    ends = upto.withColumn("_next", F.lead(F.struct(*df.columns)).over(window)).where(F.col("_next").isNull())
    earlier = before(Window.partitionBy(*keys).orderBy(CHUNK))
    last = computed_once(ends, [], F.struct(*keys, CHUNK, "_upto"))
    carried = last.select(*keys, CHUNK, F.max("_upto").over(earlier).alias("_carry"))
    return (
        upto.withColumn("_local", local)
        .join(carried, [*keys, CHUNK], "left")
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_local", "_carry", "_upto")
    )


def least_ahead(df: DataFrame, keys: Sequence[str], time: str, value: Column, out: str) -> DataFrame:
    """The least ``value`` among a key's rows at the row's own time or later; nulls are passed over. Needs the chunk column."""
    onward = Window.partitionBy(*keys, CHUNK).orderBy(F.col(time).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = before(Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc()))
    carried = (
        df.groupBy(*keys, CHUNK)
        .agg(F.min(value).alias("_chunk_min"))
        .select(*(F.col(k).alias(f"_of_{k}") for k in (*keys, CHUNK)), F.min("_chunk_min").over(later).alias("_carry"))
    )
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, CHUNK)]
    return (
        df.withColumn("_local", F.min(value).over(onward))
        .join(carried, same, "left")
        .select(*df.columns, F.least("_local", "_carry").alias(out))
    )


def join_across_chunks(
    pieces: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    at_edge: Column,
    starts_new: Callable[[WindowSpec], Column],
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Merge pieces that are already merged inside their chunk across chunk edges.

    ``at_edge`` marks the pieces a neighbouring chunk could reach (a handful per chunk). Those meet in
    one group per key; every other piece stays in its own chunk's group and is final. ``starts_new``
    says, over the window of a group, whether a piece opens a new run.
    """
    grouped = pieces.withColumn("_slot", F.when(~at_edge, F.col(CHUNK)))
    window = Window.partitionBy(*keys, "_slot").orderBy(start)
    runs = grouped.withColumn("_new", F.when(starts_new(window), 1).otherwise(0)).withColumn(
        "_run", F.sum("_new").over(up_to(window))
    )
    aggregates = {start: F.min(start), end: F.max(end), **(extra or {})}
    return (
        runs.groupBy(*keys, "_slot", "_run")
        .agg(*[expr.alias(name) for name, expr in aggregates.items()])
        .drop("_slot", "_run")
    )
