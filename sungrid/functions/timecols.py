"""Timestamp column expressions. Timestamps are TIMESTAMP_NTZ holding UTC."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SECOND = 1_000_000  # microseconds


def micros(ts: Column) -> Column:
    """Microseconds since the epoch (session zone is UTC, see session.use_utc)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(m: Column) -> Column:
    return F.timestamp_micros(m).cast("timestamp_ntz")


def floor_ts(ts: Column, step_s: int, origin_us: Column | int = 0) -> Column:
    """Start of the bin of ``step_s`` seconds that holds ``ts``."""
    m, step = micros(ts), step_s * SECOND
    if isinstance(origin_us, int) and origin_us == 0:
        return from_micros(m - F.pmod(m, F.lit(step)))
    origin = F.lit(origin_us) if isinstance(origin_us, int) else origin_us
    return from_micros(m - F.pmod(m - origin, F.lit(step)))


def ceil_ts(ts: Column, step_s: int) -> Column:
    m, step = micros(ts), step_s * SECOND
    return from_micros(m + F.pmod(-m, F.lit(step)))


def step_index(ts: Column, step_s: int) -> Column:
    """Number of whole steps since the epoch: consecutive on a regular grid."""
    m, step = micros(ts), F.lit(step_s * SECOND)
    return ((m - F.pmod(m, step)) / step).cast("long")


def shift_ts(ts: Column, seconds: Column | int) -> Column:
    secs = F.lit(seconds) if isinstance(seconds, int) else seconds
    return from_micros(micros(ts) + secs.cast("long") * F.lit(SECOND))


def parse_ts(text: Column, fmt: str) -> Column:
    """Parse text to a zone-less timestamp; text that does not fit gives NULL."""
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def utc_to_local(ts: Column, zone: str) -> Column:
    # Unlike convert_timezone, this looks a literal zone up once and not per row.
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def local_to_utc(ts: Column, zone: str) -> Column:
    """Local wall-clock time to UTC; NULL in the spring gap and autumn fold.

    Spark maps a gap time forward and a fold time to its earlier instant. A gap
    time does not come back from the round trip, and a fold time has a second
    instant one hour away that shows the same wall clock.
    """
    utc = F.to_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")
    back = utc_to_local(utc, zone)
    later = utc_to_local(utc + F.expr("INTERVAL 1 HOUR"), zone)
    earlier = utc_to_local(utc - F.expr("INTERVAL 1 HOUR"), zone)
    return F.when((back == ts) & (later != ts) & (earlier != ts), utc)


def hour_of_day(ts: Column) -> Column:
    """Hour with the minute as its fraction."""
    return F.hour(ts) + F.minute(ts) / F.lit(60.0)


def cyclical(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a quantity that repeats every ``period``."""
    angle = x * F.lit(2.0 * math.pi / period)
    return F.sin(angle), F.cos(angle)
