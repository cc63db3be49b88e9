"""Trace and log-record panels over spans."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.predicates import only, time_filter, time_interval
from eventloom.functions.quantiles import approx_quantile, exact_quantile

# Status texts that mean an error, and the service left out of some panels.
ERROR_STATUS = ("Error", "STATUS_CODE_ERROR")
HIDDEN_SERVICE = "loadgenerator"

TimeRange = tuple[datetime, datetime]


def _selected(spans: DataFrame, time_range: TimeRange | None, services: Sequence[str] | None,
              trace_ids: Sequence[str] | None) -> DataFrame:
    """The panel's filters; None selects everything."""
    if time_range is not None:
        spans = time_filter(spans, "Timestamp", *time_range)
    return only(only(spans, "TraceId", trace_ids), "ServiceName", services)


def _visible(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("ServiceName") != HIDDEN_SERVICE)


def _bucketed(spans: DataFrame, interval_s: int) -> DataFrame:
    return spans.withColumn("time", time_interval(F.col("Timestamp"), interval_s))


def traces_per_service(spans: DataFrame, interval_s: int, time_range: TimeRange | None = None,
                       services: Sequence[str] | None = None,
                       trace_ids: Sequence[str] | None = None, limit: int = 100_000) -> DataFrame:
    """Spans per time bucket and service."""
    chosen = _selected(spans, time_range, services, trace_ids)
    return (
        _bucketed(chosen, interval_s).groupBy("time", "ServiceName").count()
        .orderBy("time", "ServiceName").limit(limit)
    )


def service_p99(spans: DataFrame, interval_s: int, time_range: TimeRange | None = None,
                services: Sequence[str] | None = None, trace_ids: Sequence[str] | None = None,
                limit: int = 100_000, q: float = 0.99, exact: bool = False) -> DataFrame:
    """Latency quantile in ms per time bucket and service: a bounded sketch, or exact on request."""
    chosen = _visible(_selected(spans, time_range, services, trace_ids))
    quantile = exact_quantile if exact else approx_quantile
    p99 = quantile(_bucketed(chosen, interval_s), ["time", "ServiceName"], "Duration", q, "ns")
    return (
        p99.select("time", "ServiceName", (F.col("ns") / 1e6).alias("p99"))
        .orderBy("time", "ServiceName").limit(limit)
    )


def error_rate(spans: DataFrame, interval_s: int, time_range: TimeRange | None = None,
               services: Sequence[str] | None = None, trace_ids: Sequence[str] | None = None,
               limit: int = 100_000) -> DataFrame:
    """Failed spans per time bucket and service."""
    failed = _visible(spans.filter(F.col("StatusCode").isin(*ERROR_STATUS)))
    return traces_per_service(failed, interval_s, time_range, services, trace_ids, limit)


def trace_list(spans: DataFrame, time_range: TimeRange | None = None,
               services: Sequence[str] | None = None, trace_ids: Sequence[str] | None = None,
               limit: int = 100) -> DataFrame:
    """The slowest traces with their start, first service and longest span in ms.

    The ranking shuffles only (trace, longest span) through hash aggregation. Start and service
    are then looked up for the `limit` winners alone; Spark knows the ranking's size from its limit, and
    sends it to every executor where that is below its threshold.
    """
    chosen = _visible(_selected(spans, time_range, services, trace_ids))
    slowest = (
        chosen.groupBy("TraceId").agg(F.max("Duration").alias("ns"))
        .orderBy(F.desc("ns"), "TraceId").limit(limit)
    )
    first = F.min_by("ServiceName", F.struct("Timestamp", "SpanId"))
    return (
        chosen.join(slowest, "TraceId")
        .groupBy("TraceId", "ns")
        .agg(F.min("Timestamp").alias("timestamp"), first.alias("service"))
        .select("timestamp", F.col("TraceId").alias("Trace ID"),
                F.col("service").alias("Service Name"), (F.col("ns") / 1e6).alias("Duration"))
        .orderBy(F.desc("Duration"), "Trace ID")
    )


def trace_time_index(spans: DataFrame) -> DataFrame:
    """First and last moment of each trace; written once, it prunes trace lookups by time."""
    return spans.groupBy("TraceId").agg(
        F.min("Timestamp").alias("Start"), F.max("Timestamp").alias("End"))


def _tags(attributes: str) -> Column:
    pairs = F.map_entries(attributes)
    return F.transform(pairs, lambda e: F.create_map(
        F.lit("key"), e["key"], F.lit("value"), e["value"]))


def _trace_columns() -> list[Column]:
    return [
        F.col("TraceId").alias("traceID"), F.col("SpanId").alias("spanID"),
        F.col("ParentSpanId").alias("parentSpanID"), F.col("ServiceName").alias("serviceName"),
        F.col("SpanName").alias("operationName"), F.col("Timestamp").alias("startTime"),
        (F.col("Duration") / 1e6).alias("duration"),
        _tags("SpanAttributes").alias("tags"), _tags("ResourceAttributes").alias("serviceTags"),
    ]


def trace_detail(spans: DataFrame, trace_id: str, index: DataFrame | None = None,
                 time_range: TimeRange | None = None, limit: int = 1_000) -> DataFrame:
    """The timed spans of one trace, latest first.

    With the time index, the trace's own time span (plus a second) is a scalar subquery that
    reaches the scan as a range, so only files of that time are read; where spans have a `month`,
    only the folders of those months are read.
    """
    mine = spans.filter((F.col("TraceId") == trace_id) & (F.col("Duration") > 0))
    if time_range is not None:
        mine = time_filter(mine, "Timestamp", *time_range)
    if index is not None:
        entry = index.filter(F.col("TraceId") == trace_id)
        start = entry.agg(F.min("Start")).scalar()
        end = entry.agg(F.max("End") + F.expr("interval 1 second")).scalar()
        mine = mine.filter(F.col("Timestamp").between(start, end))
        if "month" in spans.columns:      # a store that is split by month
            mine = mine.filter(F.col("month").between(F.trunc(start, "month"), F.trunc(end, "month")))
    return (
        mine.orderBy(F.desc("Timestamp"), F.desc("Duration"), "SpanId").limit(limit)
        .select(*_trace_columns())
    )


def trace_spans(spans: DataFrame, trace_id: str | None = None) -> DataFrame:
    """Spans with a numeric status (2 = error), of one trace in time order or of all traces."""
    status = F.when(F.col("StatusCode").isin(*ERROR_STATUS), 2).otherwise(0).alias("statusCode")
    if trace_id is None:
        return spans.select(*_trace_columns(), status)
    mine = spans.filter(F.col("TraceId") == trace_id).orderBy("Timestamp", "SpanId")
    return mine.select(*_trace_columns(), status)


def trace_logs(records: DataFrame, limit: int = 1_000) -> DataFrame:
    """The first log records in time order."""
    return (
        records.select(F.col("Timestamp").alias("timestamp"), F.col("Body").alias("body"),
                       F.col("SeverityText").alias("level"))
        .orderBy("timestamp", "level", "body").limit(limit)
    )


def service_names(spans: DataFrame) -> DataFrame:
    """Values of the service selector."""
    return spans.select("ServiceName").distinct()


def root_trace_ids(spans: DataFrame, limit: int = 100) -> DataFrame:
    """Values of the trace selector: traces that have a root span."""
    roots = spans.filter(F.col("ParentSpanId") == "").select("TraceId").distinct()
    return roots.orderBy("TraceId").limit(limit)


def series_avg(df: DataFrame, time: str, group: str, value: str, out: str) -> DataFrame:
    """Multi-line series: average per time and group, in time order."""
    return (
        df.groupBy(F.col(time).alias("time"), group).agg(F.avg(value).alias(out))
        .orderBy("time", group)
    )


def log_series(df: DataFrame, time: str, group: str, value: str, out: str,
               digits: int | None = None) -> DataFrame:
    """The same average as text under `log_time`, optionally rounded first."""
    average = F.avg(value) if digits is None else F.round(F.avg(value), digits)
    return (
        df.groupBy(F.col(time).alias("log_time"), group).agg(average.cast("string").alias(out))
        .orderBy("log_time", group)
    )
