"""Stored sketches and sets that add up: distinct users and latency quantiles over any range of buckets.

A sketch per short bucket is kept in a table; wider buckets and panel ranges merge those rows and
never read events or spans again. Merged sketches have the error of one sketch over all the rows.
Where a count of users must be exact, the table holds the users themselves, a row for each and bucket.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.predicates import time_filter, time_filter_ms, time_interval
from eventloom.functions.timeparts import floor_ms, ms_to_time, to_ms
from eventloom.operators.traces import HIDDEN_SERVICE

TimeRange = tuple[datetime, datetime]

#: Sort orders of the stored tables; the users' tables are also split by the day of their windows.
USER_SKETCHES, LATENCY_SKETCHES = ["page", "windowStart"], ["time", "ServiceName"]
USER_SETS = [*USER_SKETCHES, "userId"]


def user_sketches(events: DataFrame, size: str = "1 minute", lg_k: int = 14) -> DataFrame:
    """`page`, `windowStart`, `windowEnd`, `users`: a HyperLogLog sketch of the users per page and window.

    With 2^lg_k registers the relative standard error of an estimate is about 1.04 / sqrt(2^lg_k), here
    under one per cent; sets far smaller than that are held exactly. Streams take it as it is.
    """
    bucket, start = _bucket(events, size)
    sketches = events.groupBy(bucket, "page").agg(F.hll_sketch_agg("userId", lg_k).alias("users"))
    return sketches.select(
        "page", start.alias("windowStart"), (start + to_ms(size)).alias("windowEnd"), "users")


def merged_users(sketches: DataFrame, size: str | None = None, time_range: TimeRange | None = None) -> DataFrame:
    """`time`, `key`, `value`: about how many different users a page had in each `size`, or in the whole
    range (`time` is then that of its first bucket)."""
    return _merged(sketches, F.hll_sketch_estimate(F.hll_union_agg("users")), size, time_range)


def user_sets(events: DataFrame, size: str = "1 minute") -> DataFrame:
    """`page`, `windowStart`, `windowEnd`, `userId`, `events`: every user of a page and window, in a row each.

    The exact form of `user_sketches`. A set is never held as one value, so no row grows with its users.
    Events without a user keep a row, so that their windows are known. Streams take it as it is.
    """
    bucket, start = _bucket(events, size)
    users = events.groupBy(bucket, "page", "userId").agg(F.count("*").alias("events"))
    return users.select(
        "page", start.alias("windowStart"), (start + to_ms(size)).alias("windowEnd"), "userId", "events")


def merged_user_sets(sets: DataFrame, size: str | None = None, time_range: TimeRange | None = None) -> DataFrame:
    """As `merged_users`, but exact: users are counted once, however many buckets and rows they are in."""
    return _merged(sets, F.count_distinct("userId"), size, time_range)


def _bucket(events: DataFrame, size: str) -> tuple[Column, Column]:
    """The key of a window, and its start in epoch ms once rows are grouped by it."""
    if events.isStreaming:
        return F.window("et", size).alias("w"), F.unix_millis("w.start")
    return floor_ms(F.col("timestamp"), to_ms(size)).alias("w"), F.col("w")


def _merged(stored: DataFrame, users: Column, size: str | None, time_range: TimeRange | None) -> DataFrame:
    if time_range is not None:
        stored = time_filter_ms(stored, "windowStart", *time_range)
    if size is None:
        merged = stored.groupBy("page").agg(F.min("windowStart").alias("at"), users.alias("users"))
    else:
        bucket = floor_ms(F.col("windowStart"), to_ms(size)).alias("at")
        merged = stored.groupBy("page", bucket).agg(users.alias("users"))
    return merged.select(
        ms_to_time(F.col("at")).alias("time"), F.col("page").alias("key"),
        F.col("users").cast("double").alias("value")).orderBy("time", "key")


def latency_sketches(spans: DataFrame, interval_s: int, k: int = 4096) -> DataFrame:
    """`time`, `ServiceName`, `latency`: a KLL sketch of span durations per bucket and service.

    The rank error of a quantile is about 2.3 / k^0.9 with near certainty, here about a thousandth; fewer
    than k values are held exactly.
    """
    return (
        spans.filter(F.col("ServiceName") != HIDDEN_SERVICE)
        .groupBy(time_interval(F.col("Timestamp"), interval_s).alias("time"), "ServiceName")
        .agg(F.kll_sketch_agg_bigint("Duration", k).alias("latency"))
    )


def merged_quantile(sketches: DataFrame, interval_s: int, q: float = 0.99, time_range: TimeRange | None = None,
                    limit: int = 100_000, k: int = 4096) -> DataFrame:
    """`time`, `ServiceName`, `p99` in ms per wider bucket, from the stored sketches alone."""
    if time_range is not None:
        sketches = time_filter(sketches, "time", *time_range)
    return (
        sketches.groupBy(time_interval(F.col("time"), interval_s).alias("bucket"), "ServiceName")
        .agg(F.kll_merge_agg_bigint("latency", k).alias("latency"))
        .select(F.col("bucket").alias("time"), "ServiceName",
                (F.kll_sketch_get_quantile_bigint("latency", F.lit(q)) / 1e6).alias("p99"))
        .orderBy("time", "ServiceName").limit(limit)
    )
