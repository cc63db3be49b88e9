"""Streaming jobs: one query per metric, each with its own checkpoint and table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.config import JobConfig
from eventloom.operators import behaviour as b
from eventloom.operators.funnel import funnel_stats
from eventloom.operators.sensors import sensor_aggregates, sensor_messages
from eventloom.schemas import DECODED, RESULT_TABLES, STORED_EVENT, USER_EVENT
from eventloom.session import ROCKSDB
from eventloom.sources.decode import (
    CDC_REASONS, EVENT_REASONS, count_reasons, parse_cdc, readings_of, tagged_changes, tagged_events)
from eventloom.sources.files import parquet_stream
from eventloom.streaming.drain import put_marker, with_markers
from eventloom.streaming.sinks import to_table, to_topic, topic_records, topic_table

METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "events_per_type": b.events_per_type,
    "page_views": b.page_views,
    "unique_users_per_page": b.unique_users_per_page,
    "conversion_rate": b.conversion_rate,
    "session_stats": b.session_stats,
    "funnel_stats": funnel_stats,
    "activity_heatmap": b.activity_heatmap,
    "retention": b.retention,
    "count_metrics": b.count_metrics,
}

# One stream and one table per metric, or the three plain counts sharing a stream and a table.
SEPARATE = (
    "events_per_type", "page_views", "unique_users_per_page", "conversion_rate", "session_stats",
    "funnel_stats", "activity_heatmap", "retention",
)
SHARED = (
    "count_metrics", "unique_users_per_page", "conversion_rate", "session_stats", "funnel_stats",
    "retention",
)


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """RocksDB state, sessions merged before the shuffle (a hot user's rows shrink to sessions), and
    a partition count that the checkpoint then keeps. The session's own settings come back after.

    State rows are not counted for the progress: that costs a look-up with every write and removal.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def event_table_stream(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """The decoded events of `run_user_behaviour` as they arrive."""
    return _decoded(spark, root, "event", files_per_batch).select(*STORED_EVENT.fieldNames())


def start_metric(spark: SparkSession, name: str, rows: DataFrame, root: str, config: JobConfig,
                 output_mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Start the load of one result frame into `root/name`."""
    _, sort_by, day_of = RESULT_TABLES[name]
    with state_settings(spark, config.state_partitions):
        return to_table(rows, f"{root}/{name}", f"{root}/_checkpoints/{name}", sort_by, day_of,
                        config.files_per_day, output_mode, available_now, config)


def run_user_behaviour(spark: SparkSession, raw: DataFrame, root: str,
                       config: JobConfig | None = None, metrics: Sequence[str] = SEPARATE,
                       available_now: bool = True, drain: bool = False) -> list[StreamingQuery]:
    """Raw event text to the metric tables.

    The text is decoded once, into a table of events; every metric reads that table as its own
    stream, so metrics can be restarted or added one by one without decoding again. `raw` has
    `value` and `seq`, the order in which equal times arrived. Rejected text is kept aside with the
    reason. `drain` is for a source that ends: the windows that are open at its end
    are closed and emitted too, and events that come later are late.
    """
    config = config or JobConfig()
    if drain and not available_now:
        raise ValueError("only a source that is read up can be drained")
    decode = decode_events(spark, raw, root, config, available_now)
    if available_now:
        decode[-1].awaitTermination()

    def start(name: str) -> StreamingQuery:
        events = event_table_stream(spark, root, config.files_per_batch)
        if drain:
            events = with_markers(events, root)
        rows = METRICS[name](b.with_event_time(events, config.event_delay))
        return start_metric(spark, name, rows, root, config, available_now=available_now)

    queries = [start(name) for name in metrics]
    if drain:
        for query in queries:
            query.awaitTermination()
        put_marker(spark, root, STORED_EVENT)
        queries = [start(name) for name in metrics]
    return decode + queries


def decode_events(spark: SparkSession, raw: DataFrame, root: str, config: JobConfig | None = None,
                  available_now: bool = True) -> list[StreamingQuery]:
    """Event text to the table `decoded`, and what was set aside from there to the table `rejected`.

    Each text is read and decoded once. The progress of the first query counts what was taken and what
    was set aside, by reason. Both tables have Spark's exactly-once file log, which readers follow.
    """
    config = config or JobConfig()
    tagged = count_reasons(tagged_events(raw), EVENT_REASONS, "decoded")
    rows = tagged.select(
        *[F.col(f"event.{name}") for name in USER_EVENT.fieldNames()], "seq", "reason",
        F.when(F.col("reason").isNotNull(), F.col("value")).alias("value"),
        F.when(F.col("reason").isNull(), "event").otherwise("rejected").alias("kind"))
    first = _table_stream(rows, f"{root}/decoded", root, "decoded", config, available_now, ["kind"])
    if available_now:
        first.awaitTermination()
    bad = _decoded(spark, root, "rejected", config.files_per_batch).select("value", "seq", "reason")
    return [first, _table_stream(bad, f"{root}/rejected", root, "rejected", config, available_now)]


def _decoded(spark: SparkSession, root: str, kind: str, files_per_batch: int | None) -> DataFrame:
    """Rows of one kind of the decoded table; files of the other kind are not read."""
    return parquet_stream(spark, f"{root}/decoded", DECODED, files_per_batch).where(F.col("kind") == kind)


def _table_stream(rows: DataFrame, path: str, root: str, name: str, config: JobConfig,
                  available_now: bool, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append-only file table with Spark's own exactly-once file log."""
    writer = rows.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", f"{root}/_checkpoints/{name}")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.trigger(**config.trigger(available_now)).start()


def run_sensors(spark: SparkSession, changes: DataFrame, root: str,
                config: JobConfig | None = None, size: str = "10 seconds",
                available_now: bool = True) -> StreamingQuery:
    """Change envelopes to a log of window refinements; `latest_per_window` reads it.

    The progress counts the readings and what gave none, by reason.
    """
    config = config or JobConfig()
    readings = readings_of(count_reasons(tagged_changes(changes), CDC_REASONS, "changes"))
    rows = sensor_aggregates(readings, size, delay=config.sensor_delay)
    return start_metric(spark, "sensor_aggregates", rows, root, config, "update", available_now)


def publish_metrics(spark: SparkSession, events: DataFrame, checkpoints: str,
                    config: JobConfig | None = None, metrics: Sequence[str] = SEPARATE,
                    available_now: bool = False) -> list[StreamingQuery]:
    """Metrics of an event stream to one topic each, named like the metric."""
    config = config or JobConfig()
    timed = b.with_event_time(events, config.event_delay)
    with state_settings(spark, config.state_partitions):
        return [
            to_topic(topic_records(METRICS[name](timed)), config, name, f"{checkpoints}/{name}",
                     available_now=available_now)
            for name in metrics
        ]


def publish_sensors(spark: SparkSession, changes: DataFrame, checkpoints: str,
                    config: JobConfig | None = None, available_now: bool = False) -> StreamingQuery:
    """Every refinement of the sensor windows to their topic, keyed by device and window."""
    config = config or JobConfig()
    rows = sensor_aggregates(parse_cdc(changes), delay=config.sensor_delay)
    with state_settings(spark, config.state_partitions):
        return to_topic(sensor_messages(rows), config, config.sensor_topic,
                        f"{checkpoints}/sensors", "update", available_now)


#: Result tables that are loaded from topics of their own.
LOADED = tuple(name for name in RESULT_TABLES if name != "count_metrics")


def run_loads(messages: Mapping[str, DataFrame], root: str, config: JobConfig | None = None,
              available_now: bool = True) -> list[StreamingQuery]:
    """Result topics (name -> JSON text stream) into the result tables of the same names."""
    config, queries = config or JobConfig(), []
    for name, texts in messages.items():
        schema, sort_by, day_of = RESULT_TABLES[name]
        queries.append(topic_table(texts, schema, f"{root}/{name}", f"{root}/_checkpoints/{name}",
                                   sort_by, day_of, config.files_per_day,
                                   available_now=available_now, config=config))
    return queries
