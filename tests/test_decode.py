"""What is accepted, what is rejected, and what malformed input turns into."""

import json
from datetime import datetime

import pytest

from eventloom import jobs
from eventloom.operators import sensors
from eventloom.sources import decode, files, topics
from eventloom.config import JobConfig, shared_dir

GOOD = '{"userId":"u","event":"view","page":"/home","timestamp":5}'
REORDERED = '{"timestamp":6,"page":"/p","userId":"v","event":"click"}'
BAD = [
    '{"userId":"u","event":"view","page":"/home"}',
    '{"userId":"u","event":"view","page":"/home","timestamp":null}',
    '{"userId":"u","event":"view","page":"/home","timestamp":"soon"}',
    '{"userId":"u","event":"view","page":"/home","timestamp":5,"more":1}',
    "[1]", "7", "{bad", '"text"',
    "{'userId':'u','event':'view','page':'/home','timestamp':5}",
]


def lines(spark, texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "value string, seq bigint")


def test_gate_passes_any_json(spark):
    texts = [GOOD, "[1, 2]", "7", '"x"', "null", "{bad", "", "  ", None, '{"a":1', '{"a":1,"a":2}']
    kept = [r.value for r in decode.json_gate(lines(spark, texts)).orderBy("seq").collect()]
    assert kept == [GOOD, "[1, 2]", "7", '"x"', "null", '{"a":1,"a":2}']


def test_bad_events_are_set_aside(spark, rows):
    good, bad = decode.parse_user_events(lines(spark, [GOOD, "", " \t", REORDERED, *BAD, None]))
    assert rows(good.select("userId", "event", "page", "timestamp", "seq")) == [
        ("u", "view", "/home", 5, 0), ("v", "click", "/p", 6, 3)]
    assert [r.value for r in bad.orderBy("seq").collect()] == BAD


def test_digits_behind_the_point_are_cut(spark, rows):
    good, _ = decode.parse_user_events(lines(spark, [GOOD.replace(":5}", ":1.9}"), GOOD.replace(":5}", ":9007199254740993}")]))
    assert [r.timestamp for r in good.orderBy("seq").collect()] == [1, 9007199254740993]


def test_bad_event_fails_the_job_on_request(spark, rows):
    good, bad = decode.parse_user_events(lines(spark, [GOOD, " "]), on_error="fail")
    assert len(rows(good)) == 1 and bad.count() == 0
    for text in BAD:
        good, _ = decode.parse_user_events(lines(spark, [GOOD, text]), on_error="fail")
        with pytest.raises(Exception, match="not a user event"):
            good.collect()


def test_unusual_records(spark, rows):
    texts = {
        '{"userId":{"a":1},"event":"view","page":"/p","timestamp":5}': "wrong type",
        '{"userId":"u","event":"view","page":["p"],"timestamp":5}': "wrong type",
        '{"userId":"u","event":"view","page":"/p","timestamp":{"a":1}}': "wrong type",
        '{"userId":"u","userId":{"a":1},"event":"view","page":"/p","timestamp":5}': "wrong type",
        '{"userId":"u","event":"view","page":"/p","timestamp":5,"timestamp":null}': "missing field",
        '{"userId":"u","event":"view","page":"/p","timestamp":5,"a":{"b":[1]}}': "surplus field",
        '{"event":"view","page":"/p","timestamp":5,"more":1}': "missing field",
        '{"userId":"u","event":"view","page":"/p","timestamp":5} x': None,
        '{"userId":"u","event":"view","page":"/p","timestamp":NaN}': "not JSON",
        "[1]": "not JSON", "null": "not JSON", "{bad": "not JSON",
        '{"userId":"x","event":"view","page":"/p","timestamp":5,"userId":"u"}': None,
        '{"userId":"u","event":"view","page":"/p","timestamp":9,"timestamp":5}': None,
        '{"userId":"u","event":"view","page":"/p","timestamp":"5"}': None,
        '{"userId":"u","userId":{"a":1},"userId":"u","event":"view","page":"/p","timestamp":5}': None,
    }
    given = lines(spark, list(texts))
    assert {r.value: r.reason for r in decode.tagged_events(given).collect()} == texts
    good, bad = decode.parse_user_events(given)
    assert {tuple(r)[1:] for r in good.select("seq", "userId", "event", "page", "timestamp").collect()} == {("u", "view", "/p", 5)}
    assert good.count() == 5 and bad.count() == len(texts) - 5
    brackets = lines(spark, ['{"userId":"[u]","event":"{view","page":"/p","timestamp":5}'])
    assert [(r.userId, r.event) for r in decode.parse_user_events(brackets)[0].collect()] == [("[u]", "{view")]


@pytest.mark.parametrize("allowed", ["true", "false"])
def test_no_setting_changes_what_the_gate_and_the_decoder_take(spark, allowed):
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key)
    spark.conf.set(key, allowed)
    try:
        texts = ['{"a":1,"a":2}', '1,2', '1],[2', '"x" y', '"\t"', "NaN", "01", "// c\n1", "'a'", '1,"x"],["y"', " [] ", "\ufeff1", '"\\x"', "-0.5e3"]
        kept = [r.value for r in decode.json_gate(lines(spark, texts)).orderBy("seq").collect()]
        assert kept == ['{"a":1,"a":2}', " [] ", "-0.5e3"]
        twice = lines(spark, ['{"userId":"x","event":"view","page":"/p","timestamp":5,"userId":"u"}'])
        assert [r.userId for r in decode.parse_user_events(twice)[0].collect()] == ["u"]
    finally:
        spark.conf.set(key, before)


def envelope(op="c", after=True, **changes):
    row = {"id": 1, "device_id": "d", "temperature": 20.0, "humidity": 30.0, "pressure": 1000.0,
           "timestamp": "t", "unknown": 9}
    row.update(changes)
    return json.dumps({"schema": {"type": "struct"}, "payload": {
        "before": None, "after": row if after else None, "op": op, "ts_ms": 1, "source": {}}})


def test_cdc_keeps_complete_inserts(spark, rows):
    texts = [envelope(), envelope(timestamp=None)]
    texts += [envelope(op) for op in "udr"] + [envelope(after=False)]
    texts += [envelope(**{c: None}) for c in decode.READING_FIELDS]
    texts += ["{bad", "", "[]", "{}", '{"payload":null}', None]
    texts += [envelope(id="x"), envelope(temperature=[1]), envelope().replace('"ts_ms": 1', '"ts_ms": "late"')]
    got = rows(decode.parse_cdc(lines(spark, texts)))
    assert got == [(0, "d", 20.0, 30.0, 1000.0, "t"), (1, "d", 20.0, 30.0, 1000.0, "")]
    snapshots = decode.parse_cdc(lines(spark, texts), ops=("c", "r"))
    assert snapshots.count() == 3
    tagged = decode.tagged_changes(lines(spark, texts))
    assert rows(decode.readings_of(tagged)) == got
    none = "not an envelope"
    assert [r.reason for r in tagged.orderBy("seq").collect()] == [
        None, None, *["other operation"] * 3, "no new row", *["missing measure"] * 4, *[none] * 9]


def test_sensor_windows_and_messages(spark, rows):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    data = spark.createDataFrame(
        [("d", 20.0, 30.0, 1000.0, at(9)), ("d", 22.0, 34.0, 1002.0, at(3)),
         ("d", 1.0, 2.0, 3.0, at(10))],
        "device_id string, temperature double, humidity double, pressure double, "
        "record_time timestamp")
    out = sensors.sensor_aggregates(data)
    assert rows(out) == [("d", at(0), at(10), 21.0, 32.0, 1001.0, 2),
                         ("d", at(10), at(20), 1.0, 2.0, 3.0, 1)]
    first = sensors.sensor_messages(out).orderBy("key").first()
    assert first.key == "d@2024-01-01T00:00:00"
    assert json.loads(first.value) == {
        "device_id": "d", "window_start": "2024-01-01T00:00:00",
        "window_end": "2024-01-01T00:00:10", "avg_temp": 21.0, "avg_humidity": 32.0,
        "avg_pressure": 1001.0, "count": 2}


def test_latest_refinement_wins(spark, rows):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    log = [("d", at(0), at(10), float(n), 0.0, 0.0, n) for n in (2, 3, 1)]
    log.append(("d", at(10), at(20), 9.0, 0.0, 0.0, 1))
    df = spark.createDataFrame(
        log, "device_id string, window_start timestamp, window_end timestamp, avg_temp double, "
             "avg_humidity double, avg_pressure double, count bigint")
    got = rows(sensors.latest_per_window(df))
    assert [(r[1], r[3], r[6]) for r in got] == [(at(0), 3.0, 3), (at(10), 9.0, 1)]


def test_log_times(spark, tmp_path):
    path = str(tmp_path / "logs")
    entries = [{"timestamp": "2024-01-01T10:20:30", "level": "INFO", "event": "e", "userId": "u"},
               {"timestamp": "not a time"}, {"timestamp": None, "extra": 1}]
    (tmp_path / "logs").write_text("\n".join(json.dumps(e) for e in entries) + "\n\n")
    out = decode.parse_logs(files.json_lines(spark, path)).collect()
    assert [(r.minute, r.timestamp) for r in out] == [
        ("2024-01-01 10:20", datetime(2024, 1, 1, 10, 20, 30)), (None, None), (None, None)]


def test_topic_options():
    options = topics.topic_options(JobConfig(bootstrap="b:1"), "raw_events")
    assert options == {"kafka.bootstrap.servers": "b:1", "subscribe": "raw_events",
                       "startingOffsets": "earliest"}
    bounded = topics.topic_options(JobConfig(bootstrap="b:1", offsets_per_batch=500), "raw_events")
    assert bounded == options | {"maxOffsetsPerTrigger": "500"}


def test_settings_of_a_job(monkeypatch):
    args = jobs.arguments(["behaviour", "--once", "--drain", "--offsets-per-batch", "9", "--batch-interval", "5 seconds"])
    config = jobs.config_of(args)
    assert (config.offsets_per_batch, config.files_per_batch, args.drain) == (9, None, True)
    assert config.trigger(False) == {"processingTime": "5 seconds"} and config.trigger(True) == {"availableNow": True}
    monkeypatch.setenv("EVENTLOOM_FILES_PER_BATCH", "4")
    assert JobConfig().files_per_batch == 4 and JobConfig(files_per_batch=2).files_per_batch == 2
    with pytest.raises(SystemExit):
        jobs.arguments(["behaviour", "--drain"])
    load = jobs.arguments(["logs", "--input", "i", "--table", "t", "--run-id", "1", "--jdbc-url", "jdbc:x", "--jdbc-mode", "overwrite"])
    assert (load.jdbc_url, load.jdbc_table, load.jdbc_mode) == ("jdbc:x", "log_events", "overwrite")


def test_topic_rows_carry_arrival_order(spark, rows):
    at = datetime(2024, 1, 1)
    records = spark.createDataFrame(
        [(bytearray(b"a"), at, 0, 7), (bytearray(b"b"), at, 1, 2)],
        "value binary, timestamp timestamp, partition int, offset bigint")
    assert rows(topics.topic_rows(records)) == [("a", at, 7), ("b", at, 2**48 + 2)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
