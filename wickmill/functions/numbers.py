"""Numbers that arrive as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A cast takes type suffixes and hexadecimal digits for numbers, which no message means: as a text of its own, and inside a JSON text.
_FOREIGN = r"[0-9.][dDfF]\s*$|[xX]"
_FOREIGN_INSIDE = r'[0-9.][dDfF]\s*"|[0-9][xX]'
# A whole number may be written with a fraction or an exponent.
_WHOLE_TYPE = "decimal(38, 6)"


def may_hold_foreign(json: Column) -> Column:
    """Whether a JSON text may hold such a number: one look at the text instead of one at each number."""
    return json.rlike(_FOREIGN_INSIDE)


def _plain(text: Column, suspect: Column) -> Column:
    return F.when(~F.coalesce(suspect, F.lit(True)), text).when(~text.rlike(_FOREIGN), text)


def number(text: Column, suspect: Column) -> Column:
    """Text as a double; null where it is no decimal number. NaN and infinities pass, the candle rules refuse them.

    ``suspect`` is what :func:`may_hold_foreign` says of the JSON text around it.
    """
    return _plain(text, suspect).try_cast("double")


def whole_number(text: Column, suspect: Column) -> Column:
    """Text as a whole number, also of ``5.0``; a fraction is cut off."""
    plain = _plain(text, suspect)
    return F.coalesce(plain.try_cast("bigint"), plain.try_cast(_WHOLE_TYPE).try_cast("bigint"))
