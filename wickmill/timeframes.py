"""Timeframe tiers: widths, read limits and refresh horizons."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

# The tier names, their widths, the longest read per tier in whole days
# (None = no limit) and how far behind the clock a scheduled refresh of each tier stops.
TIER_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
TIER_LIMIT_DAYS = {"1m": 30, "5m": 90, "15m": 180, "1h": 1825, "4h": 3650, "1d": None}
TIER_END_OFFSET_SECONDS = {"5m": 60, "15m": 60, "1h": 3600, "4h": 14400, "1d": 86400}
INTERACTIVE_LIMIT_DAYS = 30

BASE_TIER = "1m"
ROLLUP_TIERS = ("5m", "15m", "1h", "4h", "1d")
DAY_SECONDS = 86400


class UnsupportedTimeframe(ValueError):
    """The tier name is not one of the six known tiers."""


class InvalidDateRange(ValueError):
    """The window is empty, reversed or longer than the tier allows."""


def tier_seconds(tier: str) -> int:
    """Width of a tier; unknown names fail before any job is planned."""
    try:
        return TIER_SECONDS[tier]
    except KeyError:
        raise UnsupportedTimeframe(f"There is no tier {tier!r}; known are {', '.join(TIER_SECONDS)}") from None


def tier_path(root: str, tier: str) -> str:
    """Folder of a tier's table below the warehouse root."""
    tier_seconds(tier)
    return f"{root.rstrip('/')}/tier={tier}"


def as_utc(moment: datetime) -> datetime:
    """Naive times are read as UTC, zoned ones converted."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def check_window(tier: str, start: datetime, end: datetime, mode: str = "interactive") -> tuple[datetime, datetime]:
    """Validate one read and return it in UTC.

    ``mode`` is ``interactive`` (tier limit and the 30-day live cap), ``service`` (tier limit only)
    or ``export`` (no span limit).
    """
    if mode not in ("interactive", "service", "export"):
        raise ValueError(f"Unknown read mode: {mode}")
    tier_seconds(tier)
    start, end = as_utc(start), as_utc(end)
    if start >= end:
        raise InvalidDateRange("start must be before end")
    if mode == "export":
        return start, end
    days = (end - start) // timedelta(days=1)
    limits = [TIER_LIMIT_DAYS[tier]]
    if mode == "interactive":
        limits.append(INTERACTIVE_LIMIT_DAYS)
    limit = min((x for x in limits if x is not None), default=None)
    if limit is not None and days > limit:
        raise InvalidDateRange(f"A {tier} read may span at most {limit} days; asked for {days} days")
    return start, end
