"""Record schemas, declared once so that no reader has to infer them."""

from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


USER_EVENT = _struct(("userId", _S), ("event", _S), ("page", _S), ("timestamp", _L))

# A decoded event, or a text that was set aside and why, as the streaming job keeps both.
DECODED = T.StructType([
    *USER_EVENT.fields, T.StructField("seq", _L, True), T.StructField("reason", _S, True),
    T.StructField("value", _S, True), T.StructField("kind", _S, True)])

# A decoded event as the streaming job keeps it: `seq` is the arrival order.
STORED_EVENT = T.StructType([*USER_EVENT.fields, T.StructField("seq", _L, True)])

METRIC = _struct(("metric", _S), ("key", _S), ("windowStart", _L), ("windowEnd", _L), ("value", _D))

SESSION_STAT = _struct(
    ("userId", _S), ("sessionStart", _L), ("sessionEnd", _L), ("durationMs", _L), ("events", _L)
)

FUNNEL_STAT = _struct(
    ("windowStart", _L), ("windowEnd", _L),
    ("viewed", _L), ("clicked", _L), ("purchased", _L),
    ("completedVC", _L), ("completedCP", _L), ("completedVCP", _L),
)

RETENTION = _struct(
    ("windowStart", _L), ("windowEnd", _L),
    ("returningUsers", _L), ("newUsers", _L), ("totalUsers", _L),
)

SENSOR_ROW = _struct(
    ("id", _L), ("device_id", _S), ("temperature", _D), ("humidity", _D), ("pressure", _D),
    ("timestamp", _S),
)

# An envelope also has `schema`, which is skipped like any unknown member. `before` and `ts_ms` are
# not read, but a wrong type in them makes the whole message invalid.
CDC_ENVELOPE = _struct(
    ("payload", _struct(("before", SENSOR_ROW), ("after", SENSOR_ROW), ("op", _S), ("ts_ms", _L))))

SENSOR_AGGREGATE = _struct(
    ("device_id", _S), ("window_start", _TS), ("window_end", _TS),
    ("avg_temp", _D), ("avg_humidity", _D), ("avg_pressure", _D), ("count", _L),
)

LOG_LINE = _struct(
    ("timestamp", _S), ("level", _S), ("event", _S), ("userId", _S), ("sessionId", _S),
    ("device", _S), ("page", _S), ("errorType", _S), ("paymentMethod", _S), ("category", _S),
    ("productId", _S),
)

SPAN = _struct(
    ("Timestamp", _TS), ("TraceId", _S), ("SpanId", _S), ("ParentSpanId", _S),
    ("ServiceName", _S), ("SpanName", _S), ("Duration", _L), ("StatusCode", _S),
    ("SpanAttributes", T.MapType(_S, _S)), ("ResourceAttributes", T.MapType(_S, _S)),
)

TRACE_TIMES = _struct(("TraceId", _S), ("Start", _TS), ("End", _TS))

LOG_RECORD = _struct(("Timestamp", _TS), ("Body", _S), ("SeverityText", _S))

# Result tables: record schema, the order rows are kept in inside each file, and the column whose
# day the files are partitioned by (epoch ms or timestamp).
_METRIC_TABLE = (METRIC, ["metric", "key", "windowStart"], "windowStart")
RESULT_TABLES = {
    "events_per_type": _METRIC_TABLE,
    "page_views": _METRIC_TABLE,
    "unique_users_per_page": _METRIC_TABLE,
    "conversion_rate": _METRIC_TABLE,
    "session_stats": (SESSION_STAT, ["userId", "sessionStart"], "sessionStart"),
    "funnel_stats": (FUNNEL_STAT, ["windowStart"], "windowStart"),
    "activity_heatmap": _METRIC_TABLE,
    "retention": (RETENTION, ["windowStart"], "windowStart"),
    "count_metrics": _METRIC_TABLE,
    "sensor_aggregates": (SENSOR_AGGREGATE, ["window_start"], "window_start"),
}
