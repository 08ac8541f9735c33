"""Candle invariants as boolean and reason-code columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: tolerance of the price comparisons.
PRICE_EPSILON = 1e-9

PRICE_COLUMNS = ("open", "high", "low", "close")
OPTIONAL_VOLUMES = ("quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume")

Rule = tuple[str, str]


def _finite(name: str) -> str:
    """Ordinary numbers: neither NaN nor infinite, which would pass or fail comparisons by accident."""
    return f"NOT isnan({name}) AND abs({name}) < double('Infinity')"


def _any(template: str, names) -> str:
    return " OR ".join(f"({template.format(name)})" for name in names)


def _outside(name: str) -> str:
    return f"{name} < low - {PRICE_EPSILON}D OR {name} > high + {PRICE_EPSILON}D"


_OHLCV = (*PRICE_COLUMNS, "volume")

# Reason code and failing condition, in the order they are tested.
PRICE_RULES: tuple[Rule, ...] = (
    ("missing_number", _any("{0} IS NULL", _OHLCV)),
    ("not_finite", " OR ".join(f"NOT ({_finite(name)})" for name in _OHLCV)),
    ("price_not_positive", _any("{0} <= 0", PRICE_COLUMNS)),
    ("negative_volume", "volume < 0"),
    ("high_below_low", f"high < low - {PRICE_EPSILON}D"),
    ("open_out_of_range", _outside("open")),
    ("close_out_of_range", _outside("close")),
)

CANDLE_RULES: tuple[Rule, ...] = (("missing_time", "timestamp IS NULL"), *PRICE_RULES)

EVENT_RULES: tuple[Rule, ...] = (
    ("blank_symbol", "symbol IS NULL OR trim(symbol) = ''"),
    ("missing_time", "timestamp IS NULL OR close_time IS NULL"),
    *PRICE_RULES,
    (
        "bad_optional_volume",
        " OR ".join(f"({n} IS NOT NULL AND (NOT ({_finite(n)}) OR {n} < 0))" for n in OPTIONAL_VOLUMES),
    ),
    ("close_before_start", "close_time < timestamp"),
    ("missing_flag", "is_closed IS NULL"),
)


def first_reason(rules: tuple[Rule, ...]) -> Column:
    """Code of the first failing rule, null when all hold."""
    return F.expr("CASE " + " ".join(f"WHEN {condition} THEN '{code}'" for code, condition in rules) + " END")


def event_reject_reason() -> Column:
    """Reason for a normalized event: symbol, times, prices, optional volumes, closed flag."""
    return first_reason(EVENT_RULES)


def candle_reject_reason() -> Column:
    """Reason for a bare candle row: time and prices."""
    return first_reason(CANDLE_RULES)


def ohlc_valid(closed: Column | None = None) -> Column:
    """True when a candle may be stored: finished, timed, and within the price invariants."""
    valid = candle_reject_reason().isNull()
    return valid if closed is None else F.coalesce(closed, F.lit(False)) & valid
