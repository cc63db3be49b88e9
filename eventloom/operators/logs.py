"""Log reports and chart queries over application log rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.predicates import time_filter
from eventloom.functions.timeparts import floor_ms, to_ms


def events_by_type(df: DataFrame) -> DataFrame:
    """Events per type, most frequent first."""
    return df.groupBy("event").count().orderBy(F.desc("count"), "event")


def errors_by_type(df: DataFrame) -> DataFrame:
    """ERROR lines per error type."""
    return df.filter(F.col("level") == "ERROR").groupBy("errorType").count()


def events_per_minute(df: DataFrame) -> DataFrame:
    """Lines per minute in time order."""
    return df.groupBy("minute").count().orderBy("minute")


def product_views_by_category(df: DataFrame) -> DataFrame:
    """Product views per category."""
    return df.filter(F.col("event") == "Product viewed").groupBy("category").count()


def events_by_device(df: DataFrame) -> DataFrame:
    """Lines per device."""
    return df.groupBy("device").count()


def user_paths(df: DataFrame, part_rows: int = 10_000, slice: str = "1 minute",
               order: Sequence[str] = ("timestamp", "seq")) -> DataFrame:
    """Each user's events in time order, as consecutive parts of at most `part_rows` events.

    A path of any length stays whole: its parts, put end to end, are the path, and no row ever holds
    more than a part. Every user is placed slice by slice: rows are ordered inside (user, slice)
    only, and what a user's earlier slices hold is added from counts per slice. So no task orders
    more raw rows than one user has in one slice, however many rows a user has.
    """
    return _parts(_places_by_slice(df.select("userId", "event", *order), slice, order), part_rows)


def _places_by_slice(rows: DataFrame, slice: str, order: Sequence[str]) -> DataFrame:
    """Position of each row in its user's order: rows in earlier time slices plus rank in its own.

    Equal places in the order are settled by the event, so both uses of the ranked rows need the same
    columns and share one shuffle.
    """
    time = order[0]
    own = Window.partitionBy("userId", "slice")
    ranked = (
        rows.withColumn("slice", floor_ms(F.unix_millis(time), to_ms(slice)))
        .withColumn("n", F.count("*").over(own))
        .withColumn("rank", F.row_number().over(own.orderBy(*order, "event")))
    )
    earlier = (
        Window.partitionBy("userId").orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = ranked.where(F.col("rank") == 1).select(
        F.col("userId").alias("offsetId"), F.col("slice").alias("offsetSlice"),
        (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    same = F.col("userId").eqNullSafe(F.col("offsetId")) & F.col("slice").eqNullSafe(
        F.col("offsetSlice"))
    return ranked.join(offsets, same).withColumn("place", F.col("before") + F.col("rank") - 1)


def _parts(placed: DataFrame, part_rows: int) -> DataFrame:
    return (
        placed.groupBy("userId", F.floor(F.col("place") / part_rows).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "event"))).alias("steps"))
        .select("userId", "part", F.col("steps.event").alias("events"))
    )


def log_reports(df: DataFrame) -> DataFrame:
    """The five count reports from one scan and one shuffle: (report, key, count)."""
    def entry(name: str, key: str, keep: Column | None = None) -> Column:
        row = F.struct(F.lit(name).alias("report"), F.col(key).alias("key"))
        return row if keep is None else F.when(keep, row)

    entries = F.array_compact(F.array(
        entry("events_by_type", "event"),
        entry("errors_by_type", "errorType", F.col("level") == "ERROR"),
        entry("events_per_minute", "minute"),
        entry("product_views_by_category", "category", F.col("event") == "Product viewed"),
        entry("events_by_device", "device"),
    ))
    return df.select(F.inline(entries)).groupBy("report", "key").count()


_OPERATORS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "IN": lambda c, v: c.isin(list(v)),
}


def chart_query(df: DataFrame, groupby: Sequence[str],
                filters: Sequence[tuple[str, str, Any]] = (),
                metrics: Sequence[str] = ("count",), row_limit: int = 100,
                time_range: tuple[datetime, datetime] | None = None) -> DataFrame:
    """One chart request: filter, group, count, keep the `row_limit` largest groups.

    `filters` are (column, operator, value). Columns match whatever their case, missing keys form
    a group of their own, and ties are cut in key order so that the result is repeatable.
    """
    if list(metrics) != ["count"]:
        raise ValueError("the only chart metric is count")
    if time_range is not None:
        df = time_filter(df, "timestamp", *time_range)
    for column, operator, value in filters:
        df = df.filter(_OPERATORS[operator](F.col(column), value))
    return (
        df.groupBy(*groupby).count()
        .orderBy(F.desc("count"), *[F.asc_nulls_first(c) for c in groupby])
        .limit(row_limit)
    )
