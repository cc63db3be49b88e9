"""Panel filters as DataFrame helpers: bounds are arguments, never spliced text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _utc(value: datetime) -> datetime:
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def from_ms(value: datetime) -> int:
    """Epoch milliseconds of a bound; a naive bound is read as UTC."""
    delta = _utc(value) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400_000) + delta.seconds * 1_000 + delta.microseconds // 1_000


def time_literal(value: datetime, kind: T.DataType, step_ms: int) -> Column:
    """A bound cut to `step_ms`, typed like the column it is compared with.

    The literal takes the column's own type, so the column is not cast and the comparison
    reaches the file scan (statistics and partition pruning keep working).
    """
    ms = from_ms(value) // step_ms * step_ms
    if isinstance(kind, T.LongType):
        return F.lit(ms)
    if isinstance(kind, T.TimestampNTZType):
        text = datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_millis(F.lit(ms))


def _between(df: DataFrame, column: str, frm: datetime, to: datetime, step_ms: int) -> DataFrame:
    kind = df.schema[column].dataType
    return df.filter(
        F.col(column).between(time_literal(frm, kind, step_ms), time_literal(to, kind, step_ms))
    )


def time_filter(df: DataFrame, column: str, frm: datetime, to: datetime) -> DataFrame:
    """Rows inside the range, both ends kept, bounds cut to whole seconds."""
    return _between(df, column, frm, to, 1_000)


def time_filter_ms(df: DataFrame, column: str, frm: datetime, to: datetime) -> DataFrame:
    """As `time_filter`, bounds cut to whole milliseconds."""
    return _between(df, column, frm, to, 1)


def date_filter(df: DataFrame, column: str, frm: date, to: date) -> DataFrame:
    """Rows whose date lies inside the range, both ends kept; a time bound counts by its UTC day."""
    first, last = (
        _utc(d).astimezone(timezone.utc).date() if isinstance(d, datetime) else d for d in (frm, to))
    return df.filter(F.col(column).between(F.lit(first), F.lit(last)))


def date_time_filter(
    df: DataFrame, date_column: str, time_column: str, frm: datetime, to: datetime
) -> DataFrame:
    """Date range first (prunes date partitions), then the exact time range."""
    return time_filter(date_filter(df, date_column, frm, to), time_column, frm, to)


def time_interval(ts: Column, seconds: int) -> Column:
    """Start of the `seconds`-wide bucket of a timestamp."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def time_interval_ms(ts: Column, ms: int) -> Column:
    """Start of the `ms`-wide bucket of a timestamp."""
    return F.timestamp_millis(F.unix_millis(ts) - F.pmod(F.unix_millis(ts), F.lit(ms)))


def conditional_all(df: DataFrame, condition: Column, selected: Any | None) -> DataFrame:
    """Apply `condition` unless the selection is None, i.e. everything is selected."""
    return df if selected is None else df.filter(condition)


def only(df: DataFrame, column: str, selected: Sequence[str] | None) -> DataFrame:
    """Rows whose `column` is among the selected values; None selects all."""
    return df if selected is None else df.filter(F.col(column).isin(list(selected)))


def adhoc_filters(df: DataFrame, pairs: Mapping[str, Any]) -> DataFrame:
    """Add key = value filters to any query."""
    for column, value in pairs.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df
