"""Dashboard panels over the result tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.predicates import time_filter, time_filter_ms
from eventloom.functions.timeparts import ms_to_time

TimeRange = tuple[datetime, datetime]


def _panel(df: DataFrame, clock: str, columns: Sequence, time_range: TimeRange | None) -> DataFrame:
    if time_range is not None:
        df = time_filter_ms(df, clock, *time_range)
    return df.select(ms_to_time(F.col(clock)).alias("time"), *columns).orderBy("time")


def metric_panel(df: DataFrame, time_range: TimeRange | None = None) -> DataFrame:
    """(time, key, value): event types, page views, unique users, activity heatmap."""
    return _panel(df, "windowStart", ["key", "value"], time_range)


def conversion_panel(df: DataFrame, time_range: TimeRange | None = None) -> DataFrame:
    """(time, value) of the conversion rate."""
    return _panel(df, "windowStart", ["value"], time_range)


def session_duration_panel(df: DataFrame, time_range: TimeRange | None = None) -> DataFrame:
    """(time, value): session length in ms at its start."""
    return _panel(df, "sessionStart", [F.col("durationMs").alias("value")], time_range)


def session_events_panel(df: DataFrame, time_range: TimeRange | None = None) -> DataFrame:
    """(time, value): events per session at its start."""
    return _panel(df, "sessionStart", [F.col("events").alias("value")], time_range)


def funnel_panel(df: DataFrame, time_range: TimeRange | None = None) -> DataFrame:
    """Users who had each step."""
    return _panel(df, "windowStart", ["viewed", "clicked", "purchased"], time_range)


def completed_funnel_panel(df: DataFrame, time_range: TimeRange | None = None) -> DataFrame:
    """Users who completed the steps in order."""
    columns = ["completedVC", "completedCP", "completedVCP"]
    return _panel(df, "windowStart", columns, time_range)


def retention_panel(df: DataFrame, time_range: TimeRange | None = None) -> DataFrame:
    """Returning, new and total users."""
    return _panel(df, "windowStart", ["returningUsers", "newUsers", "totalUsers"], time_range)


def heatmap_grid(df: DataFrame, hours: Sequence[int] = tuple(range(24))) -> DataFrame:
    """Wide heatmap: one row per time, one column per hour (the hours are fixed, so no extra scan)."""
    return (
        metric_panel(df).groupBy("time").pivot("key", [str(h) for h in hours]).agg(F.sum("value"))
        .orderBy("time")
    )


def sensor_panel(df: DataFrame, column: str, time_range: TimeRange | None = None) -> DataFrame:
    """(time, value) of one sensor column; unordered, as the panel asks for it."""
    if time_range is not None:
        df = time_filter(df, "window_start", *time_range)
    return df.select(F.col("window_start").alias("time"), F.col(column).alias("value"))
