"""Interval joins as equi-joins: both sides are cut into day bins and meet on (key, bin).

An equi-join on the key alone with a range residual would compare every pair of a hot key in one
task. With bins a hot key spreads over its days, and a pair is emitted in exactly one bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickmill.functions.time import chunk_of
from wickmill.timeframes import DAY_SECONDS

BIN = "_bin"


def _spread(df: DataFrame, start: str, end: str, seconds: int) -> DataFrame:
    """One copy of each row per bin its closed span touches."""
    return df.withColumn(BIN, F.explode(F.sequence(chunk_of(start, seconds), chunk_of(end, seconds), F.lit(seconds).cast("bigint"))))


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    bin_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Inner join of rows with equal keys whose closed spans share at least one instant."""
    (ls, le), (rs, re) = left_span, right_span
    a = _spread(left.where(F.col(ls) <= F.col(le)), ls, le, bin_seconds)
    b = _spread(right.where(F.col(rs) <= F.col(re)), rs, re, bin_seconds)
    # The later of the two starts lies in one bin that both sides occupy: emit the pair there only.
    home = F.col(BIN) == chunk_of(F.greatest(ls, rs), bin_seconds)
    return a.join(b, [*keys, BIN]).where((F.col(re) >= F.col(ls)) & (F.col(rs) <= F.col(le)) & home).drop(BIN)


def points_in_windows(
    points: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    time: str,
    start: str,
    end: str,
    bin_seconds: int = DAY_SECONDS,
) -> DataFrame:
    """Inner join of windows with the points of equal keys inside the half-open window."""
    w = _spread(windows.where(F.col(start) < F.col(end)), start, end, bin_seconds)
    p = points.withColumn(BIN, chunk_of(time, bin_seconds))
    return w.join(p, [*keys, BIN]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop(BIN)
