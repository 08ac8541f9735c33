"""Keeping costly expressions from being evaluated more than once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], struct: Column) -> DataFrame:
    """The kept columns and the fields of ``struct``, in a step filters are not pushed through.

    A filter pushed below a projection repeats the projected expressions; over parsed text that means
    parsing a value once per mention. A generator of exactly one row stops the push.
    """
    return df.select(*keep, F.inline(F.array(struct)))
