"""Time arithmetic on epoch milliseconds and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MS = {
    "millisecond": 1, "second": 1_000, "minute": 60_000,
    "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000,
}


def to_ms(interval: str) -> int:
    """`"5 minutes"` -> 300000."""
    amount, unit = interval.split()
    return int(amount) * _UNIT_MS[unit.rstrip("s")]


def floor_ms(ms: Column, size_ms: int) -> Column:
    """Start of the epoch-aligned bucket that holds `ms`."""
    return ms - F.pmod(ms, F.lit(size_ms))


def hour_of_day(ms: Column) -> Column:
    """UTC hour by integer arithmetic, whatever the session zone."""
    return F.floor(F.pmod(ms, F.lit(86_400_000)) / 3_600_000).cast("int")


def ms_to_time(ms: Column) -> Column:
    """Epoch ms to a timestamp cut to whole seconds."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def iso_seconds(ts: Column) -> Column:
    """ISO date-time without a zone suffix."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
