"""JSON text to typed rows, and the rules for what is rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.jsontext import STRICT, is_json
from eventloom.schemas import CDC_ENVELOPE, LOG_LINE, USER_EVENT

_BROKEN = "_broken"
READING_FIELDS = ("device_id", "temperature", "humidity", "pressure")


def json_gate(df: DataFrame, value: str = "value") -> DataFrame:
    """Keep well-formed JSON of any shape; everything else is dropped silently."""
    return df.filter(is_json(F.col(value)))


def not_blank(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(F.col(value).rlike(r"\S"))


def _whole_number(text: Column) -> Column:
    """A number as a long; digits behind the point are cut off, as the original decoder does."""
    return text.try_cast("decimal(38,10)").try_cast("bigint")


#: Why an event text is set aside.
EVENT_REASONS = ("not JSON", "missing field", "surplus field", "wrong type")
_TEXT_FIELDS = tuple(f.name for f in USER_EVENT.fields if isinstance(f.dataType, T.StringType))


def _typed_event(record: Column) -> Column:
    return F.struct(*[
        (_whole_number(record[f.name]) if f.name == "timestamp" else record[f.name]).alias(f.name)
        for f in USER_EVENT.fields])


def _event_verdict(text: Column, record: Column) -> Column:
    """`event` (null where it is set aside) and `reason` (null where it is not) of one text.

    `record` is the text as a map. Four members, all there, with plain values: that is nearly every
    record, and needs no second look. Else a member may be named twice, and then the last counts; a
    list or an object is no text, which a map of texts does not show. What follows the object is not
    looked at, as in the original decoder.
    """
    names = USER_EVENT.fieldNames()
    event = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in USER_EVENT.fields) + ">"

    def verdict(event_: Column, reason: Column) -> Column:
        return F.struct(event_.cast(event).alias("event"), reason.alias("reason"))

    nested = F.lit(False)
    for name in _TEXT_FIELDS:
        nested = nested | record[name].rlike(r"^\s*[\[{]")
    complete = F.size(record) == len(names)
    for name in names:
        complete = complete & record[name].isNotNull()
    plain = F.coalesce(complete & ~nested & _whole_number(record["timestamp"]).isNotNull(), F.lit(False))

    last = F.from_json(text, ", ".join(f"{n} string" for n in names), STRICT)
    kinds = F.from_json(text, ", ".join(f"{n} variant" for n in _TEXT_FIELDS), STRICT)
    missing, wrong = F.lit(False), _whole_number(last["timestamp"]).isNull()
    for name in names:
        missing = missing | last[name].isNull()
    for name in _TEXT_FIELDS:
        # A value that cannot be held as a variant, an object with a member named twice, is no text either.
        kind = F.schema_of_variant(kinds[name])
        wrong = wrong | F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), last[name].rlike(r"^\s*[\[{]"))
    surplus = F.exists(F.map_keys(record), lambda k: ~k.isin(names))
    none = F.lit(None)
    reason = (
        F.when(record.isNull(), EVENT_REASONS[0]).when(missing, EVENT_REASONS[1])
        .when(surplus, EVENT_REASONS[2]).when(wrong, EVENT_REASONS[3])
    )
    return F.when(plain, verdict(_typed_event(record), none)).otherwise(
        verdict(F.when(reason.isNull(), _typed_event(last)), reason))


def tagged_events(df: DataFrame, value: str = "value") -> DataFrame:
    """All columns of event texts with `event` (typed, or null) and `reason` (null, or why it is set
    aside). Blank lines are skipped.

    The text is decoded inside a generator: a filter over decoded columns would be pushed down and
    decode the text once per condition.
    """
    lines = not_blank(df, value)
    decoded = F.struct(F.col(value).alias("text"), F.from_json(value, "map<string,string>", STRICT).alias("record"))
    return lines.select("*", F.inline(F.transform(
        F.array(decoded), lambda d: _event_verdict(d["text"], d["record"]))))


def events_of(tagged: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, rejected rows with their `reason`) of `tagged_events`."""
    carried = [c for c in tagged.columns if c not in (value, "event", "reason", *USER_EVENT.fieldNames())]
    good = tagged.filter(F.col("reason").isNull()).select(*carried, "event.*")
    return good, tagged.filter(F.col("reason").isNotNull()).drop("event")


def count_reasons(tagged: DataFrame, reasons: Sequence[str], name: str) -> DataFrame:
    """The same rows; how many were taken and how many set aside for each reason is observed as `name`.

    A stream reports the numbers of every micro-batch in its progress.
    """
    return tagged.observe(
        name, F.count_if(F.col("reason").isNull()).alias("taken"),
        *[F.count_if(F.col("reason") == reason).alias(reason) for reason in reasons])


def parse_user_events(
    df: DataFrame, value: str = "value", on_error: str = "quarantine"
) -> tuple[DataFrame, DataFrame]:
    """Event text to (events, rejected rows with a `reason`); blank lines are skipped.

    `on_error="fail"` makes the first bad record fail the job instead; the second frame is then
    always empty. Columns besides the text (topic partition, offset) are carried along.
    """
    if on_error not in ("quarantine", "fail"):
        raise ValueError("on_error is 'quarantine' or 'fail'")
    tagged = tagged_events(df, value)
    if on_error == "quarantine":
        return events_of(tagged, value)
    problem = F.raise_error(F.concat(F.lit("not a user event: "), F.col(value)))
    checked = tagged.withColumn("event", F.when(F.col("reason").isNull(), F.col("event")).otherwise(problem))
    carried = [c for c in df.columns if c != value and c not in USER_EVENT.fieldNames()]
    return checked.select(*carried, "event.*"), df.filter(F.lit(False))


#: Why a change envelope gives no reading; rows of other operations and deletions are as they should be.
CDC_REASONS = ("not an envelope", "other operation", "no new row", "missing measure")


def tagged_changes(df: DataFrame, value: str = "value", ops: Sequence[str] = ("c",)) -> DataFrame:
    """All columns of envelopes but the text, with `reading` (null if none) and `reason` (null if one)."""
    carried = [c for c in df.columns if c != value]
    envelope = T.StructType([*CDC_ENVELOPE.fields, T.StructField(_BROKEN, T.StringType())])
    decoded = F.from_json(value, envelope, STRICT | {"columnNameOfCorruptRecord": _BROKEN})

    def verdict(e: Column) -> Column:
        payload, after = e["payload"], e["payload"]["after"]
        missing = F.lit(False)
        for name in READING_FIELDS:
            missing = missing | after[name].isNull()
        reason = (
            F.when(e.isNull() | e[_BROKEN].isNotNull() | payload.isNull(), CDC_REASONS[0])
            .when(~F.coalesce(payload["op"].isin(list(ops)), F.lit(False)), CDC_REASONS[1])
            .when(after.isNull(), CDC_REASONS[2]).when(missing, CDC_REASONS[3])
        )
        time = F.coalesce(after["timestamp"], F.lit("")).alias("timestamp")
        reading = F.struct(*[after[name].alias(name) for name in READING_FIELDS], time)
        return F.struct(F.when(reason.isNull(), reading).alias("reading"), reason.alias("reason"))

    return df.select(*carried, F.inline(F.transform(F.array(decoded), verdict)))


def readings_of(tagged: DataFrame) -> DataFrame:
    """The sensor readings of `tagged_changes`."""
    carried = [c for c in tagged.columns if c not in ("reading", "reason")]
    return tagged.filter(F.col("reason").isNull()).select(*carried, "reading.*")


def parse_cdc(df: DataFrame, value: str = "value", ops: Sequence[str] = ("c",)) -> DataFrame:
    """Change envelopes to sensor readings.

    Kept are envelopes whose operation is among `ops` (by default inserts, not snapshot rows) and
    whose new row has device and all three measures; a missing reading time becomes ''. A text that
    is broken, or has a member of a wrong type anywhere in the envelope, is dropped as a whole. As
    above, each text is decoded once.
    """
    def complete(envelope: Column) -> Column:
        kept = envelope[_BROKEN].isNull() & envelope["payload"]["op"].isin(list(ops))
        for name in READING_FIELDS:
            kept = kept & envelope["payload"]["after"][name].isNotNull()
        return kept

    def reading(envelope: Column) -> Column:
        after = envelope["payload"]["after"]
        time = F.coalesce(after["timestamp"], F.lit("")).alias("timestamp")
        return F.struct(*[after[name].alias(name) for name in READING_FIELDS], time)

    carried = [c for c in df.columns if c != value]
    envelope = T.StructType([*CDC_ENVELOPE.fields, T.StructField(_BROKEN, T.StringType())])
    options = {"columnNameOfCorruptRecord": _BROKEN, "allowSingleQuotes": "false"}
    kept = F.filter(F.array(F.from_json(value, envelope, options)), complete)
    return df.select(*carried, F.inline(F.transform(kept, reading)))


def parse_log_text(df: DataFrame, value: str = "value") -> DataFrame:
    """Log lines held as text (a topic, a text column) to typed rows."""
    return df.select(F.from_json(value, LOG_LINE).alias("_l")).select("_l.*")


def parse_logs(df: DataFrame) -> DataFrame:
    """Add `minute` and turn the text `timestamp` into a timestamp; unreadable times become null."""
    minute = F.date_format(F.col("timestamp").try_cast("timestamp"), "yyyy-MM-dd HH:mm")
    time = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return df.withColumn("minute", minute).withColumn("timestamp", time)
