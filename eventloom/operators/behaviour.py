"""User-behaviour metrics over events (userId, event, page, timestamp[ms], et[, seq]).

Each metric takes a batch or a streaming DataFrame. Streaming input is grouped with `window` so
that the watermark bounds the state. Batch input is grouped by the epoch-ms bucket start, and the
metrics whose streaming form keeps whole groups (sessions, funnel) or repeats rows (sliding
windows) have a batch form that combines before it shuffles, so no hot user lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.timeparts import floor_ms, hour_of_day, to_ms


def with_event_time(df: DataFrame, delay: str = "5 seconds") -> DataFrame:
    """Add event time `et` from the epoch-ms `timestamp`, tolerating `delay` of disorder."""
    return df.withColumn("et", F.timestamp_millis("timestamp")).withWatermark("et", delay)


def _tumbling(df: DataFrame, size: str) -> Column:
    if df.isStreaming:
        return F.window("et", size).alias("w")
    return floor_ms(F.col("timestamp"), to_ms(size)).alias("w")


def _bounds(df: DataFrame, size: str) -> list[Column]:
    """windowStart and windowEnd in epoch ms of a `_tumbling` key."""
    start = F.unix_millis("w.start") if df.isStreaming else F.col("w")
    return [start.alias("windowStart"), (start + to_ms(size)).alias("windowEnd")]


def _regroup(df: DataFrame, streaming: bool, size: str) -> Column:
    """Second-stage key: the window that holds the end of a first-stage window."""
    return F.window(F.window_time("w"), size).alias("w") if streaming else F.col("w")


def _metric(name: str, key: Column, bounds: list[Column], value: Column) -> list[Column]:
    return [F.lit(name).alias("metric"), key.alias("key"), *bounds,
            value.cast("double").alias("value")]


def _count_by(df: DataFrame, name: str, key: Column, size: str) -> DataFrame:
    counts = df.groupBy(_tumbling(df, size), key.alias("key")).agg(F.count("*").alias("n"))
    return counts.select(*_metric(name, F.col("key"), _bounds(df, size), F.col("n")))


def events_per_type(df: DataFrame, size: str = "1 minute") -> DataFrame:
    """Events per event type and window."""
    return _count_by(df, "events_per_type", F.col("event"), size)


def page_views(df: DataFrame, size: str = "1 minute") -> DataFrame:
    """Events of any type per page and window."""
    return _count_by(df, "page_views", F.col("page"), size)


def activity_heatmap(df: DataFrame, size: str = "1 minute") -> DataFrame:
    """Events per UTC hour of day and window."""
    hour = hour_of_day(F.col("timestamp")).cast("string")
    return _count_by(df, "activity_heatmap", hour, size)


def count_metrics(df: DataFrame, size: str = "1 minute") -> DataFrame:
    """`events_per_type`, `page_views` and `activity_heatmap` from one scan and one shuffle."""
    def entry(name: str, key: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), key.alias("key"))

    entries = F.array(
        entry("events_per_type", F.col("event")),
        entry("page_views", F.col("page")),
        entry("activity_heatmap", hour_of_day(F.col("timestamp")).cast("string")),
    )
    time = "et" if df.isStreaming else "timestamp"
    counts = (
        df.select(time, F.inline(entries))
        .groupBy(_tumbling(df, size), "metric", "key").agg(F.count("*").alias("n"))
    )
    return counts.select(
        "metric", "key", *_bounds(df, size), F.col("n").cast("double").alias("value"))


def unique_users_per_page(df: DataFrame, size: str = "1 minute", approx: bool = False) -> DataFrame:
    """Distinct users per page and window, exact unless `approx`."""
    window = _tumbling(df, size)
    if approx:
        users = df.groupBy(window, "page").agg(F.approx_count_distinct("userId").alias("n"))
    elif df.isStreaming:
        users = (
            df.groupBy(window, "page", "userId").agg(F.count("*").alias("n"))
            .groupBy(_regroup(df, True, size), "page").agg(F.count("*").alias("n"))
        )
    else:
        users = df.groupBy(window, "page").agg(F.count_distinct("userId").alias("n"))
    return users.select(
        *_metric("unique_users_per_page", F.col("page"), _bounds(df, size), F.col("n")))


def conversion_rate(df: DataFrame, size: str = "5 minutes", slide: str = "1 minute",
                    src: str = "view", dst: str = "purchase") -> DataFrame:
    """Share of the users active in a sliding window that had both `src` and `dst` in it.

    Order of the two does not matter. A result row carries the last `slide` of its window.
    """
    if to_ms(size) % to_ms(slide):
        raise ValueError("size must be a multiple of slide")
    per_window = _conversion_stream if df.isStreaming else _conversion_batch
    rates = per_window(df, size, slide, F.col("event") == src, F.col("event") == dst)
    rate = F.when(F.col("users") == 0, 0.0).otherwise(F.col("converted") / F.col("users"))
    return rates.select(
        *_metric("conversion_rate", F.lit("global"), _bounds(df, slide), rate))


def _conversion_stream(df: DataFrame, size: str, slide: str, src: Column, dst: Column) -> DataFrame:
    per_user = (
        df.groupBy("userId", F.window("et", size, slide).alias("w"))
        .agg((F.max(src.cast("int")) * F.max(dst.cast("int"))).alias("conv"))
    )
    return (
        per_user.groupBy(_regroup(df, True, slide))
        .agg(F.count("*").alias("users"), F.sum("conv").alias("converted"))
    )


def _conversion_batch(df: DataFrame, size: str, slide: str, src: Column, dst: Column) -> DataFrame:
    """Panes instead of overlapping windows.

    Events are first combined into one row per user and slide-wide pane. A window is named by its
    last pane; the latest active pane of a user in a window stands for the user there, so a pane
    covers the windows up to the user's next pane or until it slides out. Rows are repeated only
    after the last wide shuffle, and fold into one row per window on the map side.
    """
    panes = to_ms(size) // to_ms(slide)
    per_pane = (
        df.groupBy("userId", F.floor(F.col("timestamp") / to_ms(slide)).alias("pane"))
        .agg(F.max(src).alias("src"), F.max(dst).alias("dst"))
    )
    seen = Window.partitionBy("userId").orderBy("pane")
    latest = lambda flag: F.max(F.when(F.col(flag), F.col("pane"))).over(seen)
    covered = per_pane.select(
        "pane",
        F.least(F.col("pane") + panes, F.lead("pane").over(seen)).alias("until"),
        (F.least(latest("src"), latest("dst")) + panes).alias("conv_until"),
        (latest("src").isNotNull() & latest("dst").isNotNull()).alias("both"),
    )
    return (
        covered.select(F.explode(F.sequence("pane", F.col("until") - 1)).alias("last"),
                       "conv_until", "both")
        .groupBy("last")
        .agg(F.count("*").alias("users"),
             F.count_if(F.col("both") & (F.col("last") < F.col("conv_until"))).alias("converted"))
        .withColumn("w", F.col("last") * to_ms(slide))
    )


def session_stats(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions per user: a new one starts when the pause exceeds `gap`."""
    sessions = _sessions_stream(df, gap) if df.isStreaming else _sessions_batch(df, gap)
    return sessions.select(
        "userId", "sessionStart", "sessionEnd",
        (F.col("sessionEnd") - F.col("sessionStart")).alias("durationMs"), "events")


def _sessions_stream(df: DataFrame, gap: str) -> DataFrame:
    return df.groupBy("userId", F.session_window("et", gap)).agg(
        F.min("timestamp").alias("sessionStart"), F.max("timestamp").alias("sessionEnd"),
        F.count("*").alias("events"))


def _sessions_batch(df: DataFrame, gap: str) -> DataFrame:
    """Two events of one gap-wide bucket are always in one session, so buckets are combined first.

    What is ordered per user is then at most one row per `gap` of history, however hot the user.
    The last grouping keeps the window's partitioning by user and adds no shuffle.
    """
    gap_ms = to_ms(gap)
    buckets = (
        df.groupBy("userId", floor_ms(F.col("timestamp"), gap_ms).alias("bucket"))
        .agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
             F.count("*").alias("n"))
    )
    order = Window.partitionBy("userId").orderBy("bucket")
    pause = F.col("first") - F.lag("last").over(order)
    return (
        buckets.withColumn("starts", F.coalesce((pause > gap_ms).cast("int"), F.lit(1)))
        .withColumn("session", F.sum("starts").over(order))
        .groupBy("userId", "session")
        .agg(F.min("first").alias("sessionStart"), F.max("last").alias("sessionEnd"),
             F.sum("n").alias("events"))
    )


def retention(df: DataFrame, size: str = "1 hour") -> DataFrame:
    """Users per window with more than one event (returning) and with exactly one (new)."""
    per_user = df.groupBy("userId", _tumbling(df, size)).agg(F.count("*").alias("n"))
    totals = per_user.groupBy(_regroup(df, df.isStreaming, size)).agg(
        F.count_if(F.col("n") > 1).alias("returningUsers"),
        F.count_if(F.col("n") == 1).alias("newUsers"),
        F.count("*").alias("totalUsers"))
    return totals.select(*_bounds(df, size), "returningUsers", "newUsers", "totalUsers")
