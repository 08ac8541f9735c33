"""Time expressions on UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wickmill.timeframes import DAY_SECONDS, tier_seconds


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_to(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket holding ``ts`` (epoch alignment is UTC alignment)."""
    secs = F.unix_seconds(_col(ts))
    return F.timestamp_seconds(secs - F.pmod(secs, F.lit(seconds).cast("bigint")))


def ceil_to(ts: Column | str, seconds: int) -> Column:
    """First bucket boundary at or after ``ts``; a time on a boundary stays."""
    low = floor_to(ts, seconds)
    return F.when(low == _col(ts), low).otherwise(shift(low, seconds))


def shift(ts: Column | str, seconds: int) -> Column:
    """``ts`` moved by a fixed number of seconds."""
    return F.timestamp_micros(F.unix_micros(_col(ts)) + F.lit(seconds * 1_000_000).cast("bigint"))


def time_bucket(ts: Column | str, tier: str) -> Column:
    """Bucket start of a tier."""
    return floor_to(ts, tier_seconds(tier))


def align_start(ts: Column | str, tier: str | None = None) -> Column:
    """Window start widened to the tier; no tier means the day, which covers every tier."""
    return floor_to(ts, tier_seconds(tier or "1d"))


def align_end(ts: Column | str, tier: str | None = None) -> Column:
    """Window end widened to the tier."""
    return ceil_to(ts, tier_seconds(tier or "1d"))


def day_start(ts: Column | str) -> Column:
    """Midnight UTC of ``ts``."""
    return floor_to(ts, DAY_SECONDS)


def day_of(ts: Column | str) -> Column:
    """UTC date of ``ts``: the partition value of stored candles."""
    return F.to_date(_col(ts))


def chunk_of(ts: Column | str, seconds: int = DAY_SECONDS) -> Column:
    """Epoch second at which the epoch-aligned slice holding ``ts`` begins."""
    secs = F.unix_seconds(_col(ts))
    return secs - F.pmod(secs, F.lit(seconds).cast("bigint"))


def span_days(start: Column | str, end: Column | str) -> Column:
    """Whole days between two times, rounded down."""
    micros = F.unix_micros(_col(end)) - F.unix_micros(_col(start))
    return F.floor(micros / F.lit(DAY_SECONDS * 1_000_000)).cast("bigint")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Seconds from ``start`` to ``end`` as a double."""
    return (F.unix_micros(_col(end)) - F.unix_micros(_col(start))) / F.lit(1_000_000.0)


# The first and last millisecond of the years 1 to 9999.
FIRST_MS, LAST_MS = -62_135_596_800_000, 253_402_300_799_999


def from_epoch_ms(ms: Column | str) -> Column:
    """Epoch milliseconds to a UTC timestamp; null outside the years 1 to 9999, so a bad number never fails a job."""
    ms = _col(ms)
    return F.when(ms.between(FIRST_MS, LAST_MS), F.timestamp_millis(ms))


def to_utc(ts: Column | str) -> Column:
    """Naive times become UTC times (the session zone is UTC); zoned ones are unchanged."""
    return _col(ts).cast("timestamp")


def iso_text(ts: Column | str) -> Column:
    """ISO-8601 text with a ``+00:00`` offset; the fraction appears only when there is one."""
    ts = _col(ts)
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fraction = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000).cast("bigint")) == 0, whole).otherwise(fraction)


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 text to a timestamp; text without an offset is UTC, bad text is null."""
    return F.try_to_timestamp(_col(text))
