"""The same answers in plain SQL over the same tables, written independently of the library."""

from __future__ import annotations

MIN, HOUR, DAY = 60_000, 3_600_000, 86_400_000

_UE = """ue AS (
  SELECT user_id::VARCHAR AS "userId", event_type AS event, '/k/' || (props->>'$.k') AS page,
         epoch_us(ts) // 1000 AS t, event_id AS seq
  FROM events)"""

_READINGS = """readings AS (
  SELECT 'sensor-' || lpad((user_id % 7)::VARCHAR, 3, '0') AS device_id, value AS temperature,
         k::DOUBLE AS humidity, value + 1000 AS pressure,
         CASE WHEN k % 10 = 5 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS "timestamp",
         ts AS record_time
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events)
  WHERE k % 10 NOT IN (0, 1, 2, 3) AND k <> 99)"""

_LOGS = """logs AS (
  SELECT date_trunc('second', ts) AS "timestamp", strftime(ts, '%Y-%m-%d %H:%M') AS "minute",
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
         CASE event_type WHEN 'view' THEN 'Product viewed' WHEN 'click' THEN 'Page viewed'
              WHEN 'purchase' THEN 'Payment completed' WHEN 'signup' THEN 'User logged in'
              WHEN 'error' THEN 'Payment failed' END AS event,
         'u' || user_id AS "userId", 's' || event_id AS "sessionId",
         ['mobile', 'desktop', 'tablet'][k % 3 + 1] AS device,
         ['home', 'search', 'product', 'checkout'][k % 4 + 1] AS page,
         CASE WHEN event_type = 'error' THEN ['card_declined', 'payment_failed',
              'insufficient_funds', 'network_error', 'invalid_cvv', 'expired_card',
              'fraud_suspected'][k % 7 + 1] END AS "errorType",
         CASE WHEN event_type = 'purchase' THEN
              ['card', 'paypal', 'apple_pay', 'google_pay'][k % 4 + 1] END AS "paymentMethod",
         CASE WHEN event_type = 'view' THEN ['electronics', 'books', 'clothing', 'toys', 'sports',
              'home'][k % 6 + 1] END AS category,
         CASE WHEN event_type = 'view' THEN 'p' || (k + 100) END AS "productId",
         event_id AS seq
  FROM (SELECT *, (props->>'$.k')::INT AS k FROM events))"""

_SPANS = """spans AS (
  SELECT l_shipdate AS "Timestamp", l_orderkey::VARCHAR AS "TraceId", span AS "SpanId",
         CASE WHEN l_linenumber = 1 THEN ''
              ELSE l_orderkey || '-' || (l_linenumber - 1) END AS "ParentSpanId",
         l_returnflag AS "ServiceName", 'line-' || l_linenumber AS "SpanName",
         (l_quantity * 1000000)::BIGINT AS "Duration",
         CASE WHEN l_linestatus = 'F' THEN 'Error' ELSE 'Ok' END AS "StatusCode",
         l_partkey, l_suppkey
  FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS span
        FROM lineitem))"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _count(metric: str, key: str, size: int) -> str:
    return _with(_UE) + f"""SELECT '{metric}' AS metric, ({key})::VARCHAR AS "key",
      t - t % {size} AS "windowStart", t - t % {size} + {size} AS "windowEnd",
      count(*)::DOUBLE AS "value" FROM ue GROUP BY ALL"""


def _unique(size: int) -> str:
    return _with(_UE) + f"""SELECT 'unique_users_per_page' AS metric, page AS "key",
      t - t % {size} AS "windowStart", t - t % {size} + {size} AS "windowEnd",
      count(DISTINCT "userId")::DOUBLE AS "value" FROM ue GROUP BY ALL"""


def _conversion(size: int, slide: int) -> str:
    n = size // slide
    return _with(_UE, f"""
      slides AS (SELECT "userId", event, t - t % {slide} - i * {slide} AS s
                 FROM ue, (SELECT unnest(range(0, {n})) AS i)),
      users AS (SELECT "userId", s, max((event = 'view')::INT) * max((event = 'purchase')::INT) AS c
                FROM slides GROUP BY ALL)""") + f"""
      SELECT 'conversion_rate' AS metric, 'global' AS "key", s + {size - slide} AS "windowStart",
             s + {size} AS "windowEnd", sum(c) / count(*) AS "value" FROM users GROUP BY s"""


def _sessions(gap: int) -> str:
    return _with(_UE, f"""
      marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY "userId" ORDER BY t, seq) <= {gap}
                                THEN 0 ELSE 1 END AS fresh FROM ue),
      numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY "userId" ORDER BY t, seq
                                              ROWS UNBOUNDED PRECEDING) AS s FROM marked)""") + """
      SELECT "userId", min(t) AS "sessionStart", max(t) AS "sessionEnd",
             max(t) - min(t) AS "durationMs", count(*) AS events
      FROM numbered GROUP BY "userId", s"""


def _funnel(size: int) -> str:
    return _with(_UE, f"""
      r AS (SELECT "userId", t - t % {size} AS ws, event, row_number() OVER (
              PARTITION BY "userId", t - t % {size} ORDER BY t, seq) AS n FROM ue),
      v AS (SELECT "userId", ws, min(n) FILTER (event = 'view') AS v,
                   max((event = 'view')::INT) AS viewed, max((event = 'click')::INT) AS clicked,
                   max((event = 'purchase')::INT) AS purchased FROM r GROUP BY ALL),
      c AS (SELECT "userId", ws, min(n) AS c FROM r JOIN v USING ("userId", ws)
            WHERE event = 'click' AND n > v GROUP BY ALL),
      p AS (SELECT "userId", ws, min(n) AS p FROM r JOIN c USING ("userId", ws)
            WHERE event = 'purchase' AND n > c GROUP BY ALL)""") + f"""
      SELECT ws AS "windowStart", ws + {size} AS "windowEnd", sum(viewed)::BIGINT AS viewed,
             sum(clicked)::BIGINT AS clicked, sum(purchased)::BIGINT AS purchased,
             count(c) AS "completedVC", count(p) AS "completedCP", count(p) AS "completedVCP"
      FROM v LEFT JOIN c USING ("userId", ws) LEFT JOIN p USING ("userId", ws) GROUP BY ws"""


def _retention(size: int) -> str:
    return _with(_UE, f"""
      u AS (SELECT "userId", t - t % {size} AS ws, count(*) AS n FROM ue GROUP BY ALL)""") + f"""
      SELECT ws AS "windowStart", ws + {size} AS "windowEnd",
             count(*) FILTER (n > 1) AS "returningUsers", count(*) FILTER (n = 1) AS "newUsers",
             count(*) AS "totalUsers" FROM u GROUP BY ws"""


_HOUR = f"t // {HOUR} % 24"
_COUNT_METRICS = [("events_per_type", "event"), ("page_views", "page"), ("activity_heatmap", _HOUR)]


def _all_counts(size: int) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM ({_count(name, key, size)})" for name, key in _COUNT_METRICS)


BEHAVIOUR = {
    "events_per_type": _count("events_per_type", "event", MIN),
    "page_views": _count("page_views", "page", MIN),
    "unique_users_per_page": _unique(MIN),
    "unique_users_per_page_1d": _unique(DAY),
    "conversion_rate": _conversion(5 * MIN, MIN),
    "conversion_rate_wide": _conversion(5 * DAY, DAY),
    "session_stats": _sessions(30 * MIN),
    "session_stats_6h": _sessions(6 * HOUR),
    "funnel_stats": _funnel(5 * MIN),
    "funnel_stats_7d": _funnel(7 * DAY),
    "activity_heatmap": _count("activity_heatmap", _HOUR, MIN),
    "activity_heatmap_1d": _count("activity_heatmap", _HOUR, DAY),
    "retention": _retention(HOUR),
    "retention_1d": _retention(DAY),
    "count_metrics": _all_counts(MIN),
}


def _sensor(seconds: int) -> str:
    return _with(_READINGS) + f"""
      SELECT device_id, make_timestamp(s * 1000000) AS window_start,
             make_timestamp((s + {seconds}) * 1000000) AS window_end,
             round(avg(temperature), 6) AS avg_temp, round(avg(humidity), 6) AS avg_humidity,
             round(avg(pressure), 6) AS avg_pressure, count(*) AS "count"
      FROM (SELECT *, epoch_us(record_time) // 1000000 // {seconds} * {seconds} AS s FROM readings)
      GROUP BY device_id, s"""


SENSORS = {
    "cdc_decode": _with(_READINGS) + "SELECT * FROM readings",
    "sensor_aggregates": _sensor(10),
    "sensor_aggregates_1d": _sensor(86_400),
    "sensor_messages": f"""
      SELECT device_id || '@' || a AS "key",
             '{{"device_id":"' || device_id || '","window_start":"' || a || '","window_end":"' || b
             || '","avg_temp":' || avg_temp || ',"avg_humidity":' || avg_humidity
             || ',"avg_pressure":' || avg_pressure || ',"count":' || "count"
             || '}}' AS "value"
      FROM (SELECT *, strftime(window_start, '%Y-%m-%dT%H:%M:%S') AS a,
                   strftime(window_end, '%Y-%m-%dT%H:%M:%S') AS b FROM ({_sensor(86_400)}))""",
}


def _chart(keys: str, where: str = "true") -> str:
    order = ", ".join(f"{k} NULLS FIRST" for k in keys.split(", "))
    named = ", ".join(f"{k} AS {k}" for k in keys.split(", "))
    return _with(_LOGS) + f"""SELECT {named}, count(*) AS "count" FROM logs WHERE {where}
      GROUP BY ALL ORDER BY "count" DESC, {order} LIMIT 100"""


def _report(key: str, where: str = "true") -> str:
    return _with(_LOGS) + f"""SELECT {key}, count(*) AS "count" FROM logs WHERE {where}
      GROUP BY ALL"""


def _paths(part_rows: int) -> str:
    return _with(_LOGS) + f"""
      SELECT "userId", n // {part_rows} AS part,
             to_json(list(event ORDER BY n))::VARCHAR AS events
      FROM (SELECT *, row_number() OVER (
              PARTITION BY "userId" ORDER BY "timestamp", seq) - 1 AS n FROM logs)
      GROUP BY "userId", n // {part_rows}"""


LOGS = {
    "log_decode": _with(_LOGS) + "SELECT * EXCLUDE (seq) FROM logs",
    "log_file": _with(_LOGS) + "SELECT * EXCLUDE (seq) FROM logs",
    "events_by_type": _report("event"),
    "errors_by_type": _report('"errorType"', "level = 'ERROR'"),
    "events_per_minute": _report('"minute"'),
    "user_paths": _paths(10_000),
    "user_paths_short_parts": _paths(25),
    "product_views_by_category": _report("category", "event = 'Product viewed'"),
    "events_by_device": _report("device"),
    "log_reports": _with(_LOGS) + """
      SELECT 'events_by_type' AS report, event AS "key", count(*) AS "count" FROM logs GROUP BY ALL
      UNION ALL SELECT 'errors_by_type', "errorType", count(*) FROM logs WHERE level = 'ERROR'
      GROUP BY ALL
      UNION ALL SELECT 'events_per_minute', "minute", count(*) FROM logs GROUP BY ALL
      UNION ALL SELECT 'product_views_by_category', category, count(*) FROM logs
      WHERE event = 'Product viewed' GROUP BY ALL
      UNION ALL SELECT 'events_by_device', device, count(*) FROM logs GROUP BY ALL""",
    "chart_events_by_type": _chart("event"),
    "chart_events_per_minute": _chart('"minute"'),
    "chart_errors_over_time": _chart('"minute"', "level = 'ERROR'"),
    "chart_errors_by_type": _chart("errortype"),
    "chart_products_by_category": _chart("category"),
    "chart_payments_by_method": _chart("paymentmethod"),
    "chart_time_range": _chart("event, device", """
      "timestamp" BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'"""),
}


def _panel(sql: str, clock: str, columns: str, where: str = "true") -> str:
    return f"""SELECT make_timestamp("{clock}" // 1000 * 1000000) AS "time", {columns}
      FROM ({sql}) WHERE {where}"""


def _sensor_panel(column: str) -> str:
    return f'SELECT window_start AS "time", {column} AS "value" FROM ({SENSORS["sensor_aggregates"]})'


_HOUR_COLUMNS = ", ".join(
    f'sum("value") FILTER ("key" = \'{h}\') AS "{h}"' for h in range(24))
_RETENTION_COLUMNS = '"returningUsers", "newUsers", "totalUsers"'

PANELS = {
    "panel_events_per_type": _panel(BEHAVIOUR["events_per_type"], "windowStart", '"key", "value"'),
    "panel_page_views": _panel(BEHAVIOUR["page_views"], "windowStart", '"key", "value"'),
    "panel_unique_users": _panel(
        BEHAVIOUR["unique_users_per_page"], "windowStart", '"key", "value"'),
    "panel_conversion": _panel(BEHAVIOUR["conversion_rate"], "windowStart", '"value"'),
    "panel_session_duration": _panel(
        BEHAVIOUR["session_stats"], "sessionStart", '"durationMs" AS "value"'),
    "panel_events_per_session": _panel(
        BEHAVIOUR["session_stats"], "sessionStart", 'events AS "value"'),
    "panel_funnel": _panel(BEHAVIOUR["funnel_stats"], "windowStart", "viewed, clicked, purchased"),
    "panel_completed_funnels": _panel(
        BEHAVIOUR["funnel_stats"], "windowStart", '"completedVC", "completedCP", "completedVCP"'),
    "panel_heatmap": _panel(BEHAVIOUR["activity_heatmap"], "windowStart", '"key", "value"'),
    "panel_heatmap_grid": _panel(
        BEHAVIOUR["activity_heatmap"], "windowStart",
        _HOUR_COLUMNS, "true GROUP BY ALL"),
    "panel_retention": _panel(BEHAVIOUR["retention"], "windowStart", _RETENTION_COLUMNS),
    "panel_retention_range": _panel(
        BEHAVIOUR["retention"], "windowStart", _RETENTION_COLUMNS,
        """"windowStart" BETWEEN epoch_ms(TIMESTAMP '2024-01-10 06:00:00')
           AND epoch_ms(TIMESTAMP '2024-01-12 18:30:00')"""),
    "panel_avg_temp": _sensor_panel("avg_temp"),
    "panel_avg_humidity": _sensor_panel("avg_humidity"),
    "panel_avg_pressure": _sensor_panel("avg_pressure"),
    "panel_sensor_count": _sensor_panel('"count"'),
}

_TEXT_CTE = _UE + """, text AS (
  SELECT *, '{"userId":"' || "userId" || '","event":"' || event || '","page":"' || page
            || '","timestamp":' || t || '}' AS body FROM ue)"""

TEXT = {
    "json_gate": _with(_TEXT_CTE) + 'SELECT body AS "value", seq FROM text WHERE seq % 7 <> 0',
    "parse_user_events": _with(_UE) + """
      SELECT "userId", event, page, t AS "timestamp", seq FROM ue WHERE seq % 7 <> 0""",
    "parse_user_events_strict": _with(_UE) + """
      SELECT "userId", event, page, t AS "timestamp", seq FROM ue""",
    "rejected_user_events": _with(_TEXT_CTE) + """
      SELECT seq, '{' || body AS "value", 'not JSON' AS reason FROM text WHERE seq % 7 = 0""",
    "parse_odd_events": _with(_UE) + """
      SELECT "userId", event, page, t AS "timestamp", seq FROM ue WHERE seq % 11 IN (5, 6, 9, 10)""",
    "event_reasons": """SELECT CASE WHEN event_id % 11 = 0 THEN 'not JSON' WHEN event_id % 11 IN (1, 8) THEN 'missing field'
        WHEN event_id % 11 = 2 THEN 'surplus field' WHEN event_id % 11 IN (3, 4, 7) THEN 'wrong type' ELSE 'taken' END AS reason,
      count(*) AS n FROM events GROUP BY ALL""",
    "cdc_reasons": """SELECT CASE WHEN k = 99 THEN 'not an envelope' WHEN k % 10 IN (0, 1, 3) THEN 'other operation'
        WHEN k % 10 = 2 THEN 'missing measure' ELSE 'taken' END AS reason, count(*) AS n
      FROM (SELECT (props->>'$.k')::INT AS k FROM events) GROUP BY ALL""",
    "topic_records": f"""
      SELECT "windowStart"::VARCHAR AS "key", '{{"windowStart":' || "windowStart"
             || ',"windowEnd":' || "windowEnd" || ',"returningUsers":' || "returningUsers"
             || ',"newUsers":' || "newUsers" || ',"totalUsers":' || "totalUsers" || '}}' AS "value"
      FROM ({BEHAVIOUR["retention"]})""",
}

_BARE = "SELECT event_id, ts, event_type FROM events"
_ALL_SERVICES = """SELECT "Timestamp" AS {time}, "ServiceName", {value}
      FROM spans GROUP BY ALL"""


def _bucket(ms: int) -> str:
    return _with(_UE) + f"""SELECT make_timestamp((t - t % {ms}) * 1000) AS "time", count(*) AS n
      FROM ue GROUP BY ALL"""


TIME_SERIES = {
    "time_filter": _BARE + """ WHERE ts >= TIMESTAMP '2024-01-10 06:00:00'
      AND ts <= TIMESTAMP '2024-01-12 18:30:00'""",
    "time_filter_ms": _BARE + """ WHERE ts >= TIMESTAMP '2024-01-10 06:00:00.250'
      AND ts <= TIMESTAMP '2024-01-12 18:30:00.750'""",
    "date_filter": _BARE + " WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'",
    "date_time_filter": _BARE + """ WHERE ts >= TIMESTAMP '2024-01-10 06:00:00'
      AND ts <= TIMESTAMP '2024-01-12 18:30:00'""",
    "date_filter_zoned": _BARE + " WHERE ts::DATE BETWEEN DATE '2024-01-11' AND DATE '2024-01-12'",
    "date_time_filter_zoned": _BARE + """ WHERE ts >= TIMESTAMP '2024-01-11 06:00:00'
      AND ts <= TIMESTAMP '2024-01-12 01:00:00'""",
    "time_interval": _bucket(20_000),
    "time_interval_ms": _bucket(500),
    "conditional_all": _BARE + " WHERE event_type IN ('view', 'click')",
    "adhoc_filter": _BARE + " WHERE event_type = 'purchase'",
    "series_avg": _with(_SPANS) + _ALL_SERVICES.format(
        time='"time"', value='round(avg("Duration"), 6) AS avg_duration'),
    "log_series": _with(_SPANS) + _ALL_SERVICES.format(
        time="log_time", value='round(avg("Duration" / 1e6), 4)::VARCHAR AS avg_ms'),
}


def _bucketed(days: int) -> str:
    return _SPANS + f""", b AS (
      SELECT *, make_timestamp(epoch_us("Timestamp") // {days * DAY * 1000} * {days * DAY * 1000})
                AS "time" FROM spans)"""


def _per_service(days: int, where: str = "true") -> str:
    return _with(_bucketed(days)) + f"""SELECT "time", "ServiceName", count(*) AS "count" FROM b
      WHERE {where} GROUP BY ALL ORDER BY "time", "ServiceName" LIMIT 100000"""


def _p99(days: int, function: str) -> str:
    return _with(_bucketed(days)) + f"""SELECT "time", "ServiceName",
      round({function}("Duration", 0.99) / 1e6, 6) AS p99 FROM b
      WHERE "ServiceName" <> 'loadgenerator' GROUP BY ALL
      ORDER BY "time", "ServiceName" LIMIT 100000"""


def _tag(name: str) -> str:
    return f"""'[{{"key":"{name}","value":"' || l_{name} || '"}}]'"""


_DETAIL = f"""SELECT "TraceId" AS "traceID", "SpanId" AS "spanID", "ParentSpanId" AS "parentSpanID",
  "ServiceName" AS "serviceName", "SpanName" AS "operationName", "Timestamp" AS "startTime",
  "Duration" / 1e6 AS duration, {_tag("partkey")} AS tags, {_tag("suppkey")} AS "serviceTags" """

TRACES = {
    "traces_per_service": _per_service(1),
    "traces_per_service_range": _per_service(7, """"ServiceName" IN ('A', 'R') AND "Timestamp"
      BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31'"""),
    "service_p99": _p99(1, "quantile_cont"),
    "service_p99_approx": _p99(1, "quantile_disc"),
    "service_p99_month": _p99(30, "quantile_cont"),
    "error_rate": _per_service(1, """"StatusCode" IN ('Error', 'STATUS_CODE_ERROR')
      AND "ServiceName" <> 'loadgenerator'"""),
    "trace_list": _with(_SPANS) + """SELECT min("Timestamp") AS "timestamp",
      "TraceId" AS "Trace ID", first("ServiceName" ORDER BY "Timestamp", "SpanId")
      AS "Service Name", max("Duration") / 1e6 AS "Duration" FROM spans
      WHERE "ServiceName" <> 'loadgenerator' GROUP BY "TraceId"
      ORDER BY "Duration" DESC, "Trace ID" LIMIT 100""",
    "trace_detail": _with(_SPANS) + _DETAIL + """FROM spans WHERE "TraceId" = '1'
      AND "Duration" > 0 ORDER BY "Timestamp" DESC, "Duration" DESC, "SpanId" LIMIT 1000""",
    "trace_detail_status": _with(_SPANS) + _DETAIL + """, CASE WHEN "StatusCode" IN
      ('Error', 'STATUS_CODE_ERROR') THEN 2 ELSE 0 END AS "statusCode" FROM spans""",
    "trace_logs": """SELECT make_timestamp((1704067200 + conv_id * 60 + turn) * 1000000)
      AS "timestamp", text AS body, role AS level FROM conversations
      ORDER BY "timestamp", level, body LIMIT 1000""",
    "service_names": _with(_SPANS) + 'SELECT DISTINCT "ServiceName" FROM spans',
    "root_trace_ids": _with(_SPANS) + """SELECT DISTINCT "TraceId" FROM spans
      WHERE "ParentSpanId" = '' ORDER BY "TraceId" LIMIT 100""",
    "trace_time_index": _with(_SPANS) + """SELECT "TraceId", min("Timestamp") AS "Start",
      max("Timestamp") AS "End" FROM spans GROUP BY ALL""",
}
TRACES["trace_times_stored"] = TRACES["trace_time_index"]

# Sketches hold small sets exactly: here they must give the exact answers.
SKETCHES = {
    "merged_users_1d": f"""SELECT make_timestamp("windowStart" * 1000) AS "time", "key", "value"
      FROM ({BEHAVIOUR["unique_users_per_page_1d"]})""",
    "merged_users_range": _with(_UE) + """SELECT make_timestamp(min(t - t % 60000) * 1000) AS "time", page AS "key",
      count(DISTINCT "userId")::DOUBLE AS "value" FROM ue
      WHERE t - t % 60000 BETWEEN epoch_ms(TIMESTAMP '2024-01-10 06:00:00') AND epoch_ms(TIMESTAMP '2024-01-12 18:30:00')
      GROUP BY page""",
    "merged_p99_day": _p99(1, "quantile_disc"), "merged_p99_week": _p99(7, "quantile_disc"),
    "merged_p99_month": _p99(30, "quantile_disc"),
}

_LATE = _with(_UE, f"""
  last AS (SELECT max(t) AS t FROM ue),
  given AS (SELECT event, t FROM ue UNION ALL
            SELECT event, ue.t FROM ue, last WHERE seq % 97 = 0 AND ue.t - ue.t % {MIN} + {MIN} > last.t - 5000)""") + f"""
  SELECT 'events_per_type' AS metric, event AS "key", t - t % {MIN} AS "windowStart",
         t - t % {MIN} + {MIN} AS "windowEnd", count(*)::DOUBLE AS "value" FROM given GROUP BY ALL"""

# A stream over a table that ends emits what the batch over it gives.
STREAMS = {
    **{f"stream_{name}": BEHAVIOUR[name] for name in (
        "events_per_type", "page_views", "unique_users_per_page", "conversion_rate", "session_stats",
        "funnel_stats", "activity_heatmap", "retention", "count_metrics", "conversion_rate_wide",
        "funnel_stats_7d")},
    "stream_sensor_aggregates": SENSORS["sensor_aggregates"],
    "stream_topic_table": _with(_UE) + """
      SELECT "userId", event, page, t AS "timestamp" FROM ue""",
    "stream_late_rows": _LATE,
    "stream_open_windows": f"""SELECT "key", "windowStart", "windowEnd", "value"::BIGINT AS n
      FROM ({BEHAVIOUR["events_per_type"]})
      WHERE "windowEnd" > (SELECT max(epoch_us(ts) // 1000) - 5000 FROM events)""",
    "stream_bounded_batches": "SELECT 3::BIGINT AS n_batches, count(*) AS n_rows FROM events",
    "stream_compacted_table": f"""SELECT phase, r.* FROM ({BEHAVIOUR["retention"]}) r,
      (VALUES ('before', 3), ('during', 3), ('after', 3), ('with a later run', 4)) p(phase, runs)
      WHERE "windowStart" // {HOUR} % 4 < runs""",
}

# A load gives back what was sent to the topic.
LOADS = {
    f"load_{name}": {**BEHAVIOUR, **SENSORS}[name] for name in (
        "events_per_type", "page_views", "unique_users_per_page", "conversion_rate", "session_stats",
        "funnel_stats", "activity_heatmap", "retention", "sensor_aggregates")
}

ORACLE: dict[str, str] = {
    **BEHAVIOUR, **SENSORS, **LOGS, **PANELS, **TEXT, **TIME_SERIES, **TRACES, **SKETCHES, **STREAMS, **LOADS,
}
