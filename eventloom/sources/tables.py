"""Record shapes of the library derived from the shared analytics tables.

The tables `events`, `lineitem` and `conversations` stand in for the topics, log files and trace
store: every mapping is a plain projection of whole rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.jsontext import to_json_text
from eventloom.schemas import LOG_LINE, USER_EVENT

# The domains of log lines.
DEVICES = ["mobile", "desktop", "tablet"]
PAGES = ["home", "search", "product", "checkout"]
ERROR_TYPES = [
    "card_declined", "payment_failed", "insufficient_funds", "network_error", "invalid_cvv",
    "expired_card", "fraud_suspected",
]
PAYMENT_METHODS = ["card", "paypal", "apple_pay", "google_pay"]
CATEGORIES = ["electronics", "books", "clothing", "toys", "sports", "home"]
LOG_EVENTS = {
    "view": "Product viewed", "click": "Page viewed", "purchase": "Payment completed",
    "signup": "User logged in", "error": "Payment failed",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; times in it are zone-less, so the session is pinned to UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_k(events: DataFrame) -> DataFrame:
    """`k` as a column of its own, so that the many expressions on it read the JSON once."""
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def _ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def user_events(events: DataFrame) -> DataFrame:
    """Typed user events plus `seq`, the arrival order."""
    return events.select(
        F.col("user_id").cast("string").alias("userId"), F.col("event_type").alias("event"),
        F.concat(F.lit("/k/"), F.get_json_object("props", "$.k")).alias("page"),
        _ms().alias("timestamp"),
        F.col("event_id").alias("seq"))


def user_event_text(events: DataFrame) -> DataFrame:
    """User events as JSON text, each with its arrival order."""
    return user_events(events).select(
        to_json_text(USER_EVENT.fieldNames()).alias("value"), "seq")


def raw_event_text(events: DataFrame) -> DataFrame:
    """As `user_event_text`, with every seventh payload made broken JSON by a stray brace."""
    stray = F.when(F.pmod("seq", F.lit(7)) == 0, "{").otherwise("")
    return user_event_text(events).withColumn("value", F.concat(stray, "value"))


def odd_event_text(events: DataFrame) -> DataFrame:
    """As `user_event_text`, with the ways in which a record can be unusual, by `seq` modulo 11.

    0 broken text, 1 no event, 2 a surplus member, 3 an object for the user, 4 a list for the page, 5 the
    user named twice, 6 the time as text, 7 a time that is no number, 8 no page (null); the rest plain.
    """
    case = F.pmod("seq", F.lit(11))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    member = lambda name, c: F.concat(F.lit(f'"{name}":'), c)
    pick = lambda digit, c, other: F.when(case == digit, c).otherwise(other)
    user = pick(3, F.concat(F.lit('{"id":'), quoted(F.col("userId")), F.lit("}")), quoted(F.col("userId")))
    page = F.when(case == 4, F.concat(F.lit("["), quoted(F.col("page")), F.lit("]"))).when(
        case == 8, F.lit("null")).otherwise(quoted(F.col("page")))
    time = F.when(case == 6, quoted(F.col("timestamp").cast("string"))).when(
        case == 7, F.lit('"soon"')).otherwise(F.col("timestamp").cast("string"))
    members = F.array_compact(F.array(
        F.when(case == 5, F.lit('"userId":"nobody"')), member("userId", user),
        F.when(case != 1, member("event", quoted(F.col("event")))), member("page", page), member("timestamp", time),
        F.when(case == 2, F.lit('"more":1'))))
    return user_events(events).select(
        F.concat(pick(0, F.lit("{{"), F.lit("{")), F.array_join(members, ","), F.lit("}")).alias("value"), "seq")


def cdc_text(events: DataFrame) -> DataFrame:
    """Change envelopes as JSON text with their record time.

    The last digit of k picks the case: 0 update, 1 delete without a new row, 3 snapshot row,
    2 missing temperature, 5 missing reading time; k = 99 is broken text; the rest are inserts.
    """
    k = F.col("k")
    case = F.pmod(k, F.lit(10))
    unless = lambda digit, c: F.when(case != digit, c)
    row = F.struct(
        F.col("event_id").alias("id"),
        F.concat(F.lit("sensor-"), F.lpad(F.pmod("user_id", F.lit(7)).cast("string"), 3, "0"))
        .alias("device_id"),
        unless(2, F.col("value")).alias("temperature"),
        k.cast("double").alias("humidity"),
        (F.col("value") + 1000).alias("pressure"),
        unless(5, F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
    )
    op = F.when(case == 0, "u").when(case == 1, "d").when(case == 3, "r").otherwise("c")
    payload = F.struct(
        F.when(case == 1, row).alias("before"), unless(1, row).alias("after"), op.alias("op"),
        _ms().alias("ts_ms"))
    envelope = to_json_text([F.lit(None).cast("string").alias("schema"), payload.alias("payload")])
    return _with_k(events).select(
        F.when(k == 99, "{bad").otherwise(envelope).alias("value"),
        F.col("ts").cast("timestamp").alias("record_time"))


def _pick(values: Sequence[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(index, F.lit(len(values))))


def log_lines(events: DataFrame) -> DataFrame:
    """Log rows with text fields, plus `seq`."""
    k = F.col("k")
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").otherwise("INFO")
    event = F.create_map(*[F.lit(x) for pair in LOG_EVENTS.items() for x in pair])[kind]
    return _with_k(events).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        level.alias("level"), event.alias("event"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("userId"),
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sessionId"),
        _pick(DEVICES, k).alias("device"), _pick(PAGES, k).alias("page"),
        F.when(kind == "error", _pick(ERROR_TYPES, k)).alias("errorType"),
        F.when(kind == "purchase", _pick(PAYMENT_METHODS, k)).alias("paymentMethod"),
        F.when(kind == "view", _pick(CATEGORIES, k)).alias("category"),
        F.when(kind == "view", F.concat(F.lit("p"), (k + 100).cast("string"))).alias("productId"),
        F.col("event_id").alias("seq"))


def log_text(events: DataFrame) -> DataFrame:
    """Log lines as JSON text."""
    return log_lines(events).select(to_json_text(LOG_LINE.fieldNames()).alias("value"))


def spans(lineitem: DataFrame) -> DataFrame:
    """One span per line item; the order is the trace, line 1 a root, other lines follow the last."""
    span_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parent = F.when(F.col("l_linenumber") == 1, "").otherwise(
        F.concat_ws("-", "l_orderkey", F.col("l_linenumber") - 1))
    text = lambda c: F.col(c).cast("string")
    return lineitem.select(
        F.col("l_shipdate").cast("timestamp").alias("Timestamp"),
        text("l_orderkey").alias("TraceId"), span_id.alias("SpanId"),
        parent.alias("ParentSpanId"), F.col("l_returnflag").alias("ServiceName"),
        F.concat(F.lit("line-"), text("l_linenumber")).alias("SpanName"),
        (F.col("l_quantity") * 1_000_000).cast("bigint").alias("Duration"),
        F.when(F.col("l_linestatus") == "F", "Error").otherwise("Ok").alias("StatusCode"),
        F.create_map(F.lit("partkey"), text("l_partkey")).alias("SpanAttributes"),
        F.create_map(F.lit("suppkey"), text("l_suppkey")).alias("ResourceAttributes"))


def log_records(conversations: DataFrame) -> DataFrame:
    """One log record per turn: a minute per conversation, a second per turn."""
    seconds = F.lit(1_704_067_200) + F.col("conv_id") * 60 + F.col("turn")
    return conversations.select(
        F.timestamp_seconds(seconds).alias("Timestamp"), F.col("text").alias("Body"),
        F.col("role").alias("SeverityText"))
