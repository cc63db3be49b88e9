"""Streams against their batch counterparts, late rows, restarts, replays."""

import json
import os
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
import pytest
from test_behaviour import MIN, SCHEMA, random_events

from eventloom.config import JobConfig
from eventloom.operators import behaviour as b
from eventloom.operators import sensors
from eventloom.operators.funnel import funnel_stats
from eventloom.schemas import RESULT_TABLES
from eventloom.sources import manifest
from eventloom.sources.decode import parse_cdc
from eventloom.sources.files import parquet_stream, result_table, text_stream
from eventloom.streaming import drain, runs, sinks, state

CONFIG = JobConfig(state_partitions=2, files_per_day=2)
COLUMNS = ["userId", "event", "page", "timestamp", "seq"]


def put(spark, path, given):
    spark.createDataFrame(given, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, delay="5 seconds", files=1):
    return b.with_event_time(
        parquet_stream(spark, path, spark.createDataFrame([], SCHEMA).schema, files), delay)


def closed(found, watermark, end):
    return [r for r in found if r[end] <= watermark]


def in_order_chunks(given, chunks):
    """Files in time order, rows inside each in any order."""
    ordered = sorted(given, key=lambda r: r[3])
    size = -(-len(ordered) // chunks)
    out = [ordered[i:i + size] for i in range(0, len(ordered), size)]
    for chunk in out:
        random.Random(0).shuffle(chunk)
    return out


ENDS = {"session_stats": 2, "funnel_stats": 1, "retention": 1}


@pytest.mark.parametrize("name", list(runs.METRICS))
def test_stream_equals_batch_over_many_batches(spark, rows, tmp_path, name):
    given = random_events(11, n=300, span=200 * MIN)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for chunk in in_order_chunks(given, 4):
        put(spark, source, chunk)
    metric = runs.METRICS[name]
    query = runs.start_metric(spark, name, metric(stream_of(spark, source)), root, CONFIG)
    query.awaitTermination()
    got = rows(result_table(spark, f"{root}/{name}", RESULT_TABLES[name][0]))
    want = rows(metric(b.with_event_time(spark.createDataFrame(given, SCHEMA))))
    end = ENDS.get(name, 3)
    slack = 30 * MIN if name == "session_stats" else 0
    watermark = max(r[3] for r in given) - 5_000 - slack
    assert closed(want, watermark, end) and got == closed(want, watermark, end)


@pytest.mark.parametrize("slice", ["1 second", "1 minute", "5 minutes"])
def test_funnel_slices_do_not_change_the_result(spark, rows, tmp_path, slice):
    given = random_events(12, users=3, n=400, span=30 * MIN, grain=500)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, given + [("end", "view", "/p", 900 * MIN, 10_000)])
    stream = funnel_stats(stream_of(spark, source), slice=slice)
    runs.start_metric(spark, "funnel_stats", stream, root, CONFIG).awaitTermination()
    got = rows(result_table(spark, f"{root}/funnel_stats", RESULT_TABLES["funnel_stats"][0]))
    assert got == rows(funnel_stats(b.with_event_time(spark.createDataFrame(given, SCHEMA))))


@pytest.mark.parametrize("name", list(runs.METRICS))
def test_drained_stream_equals_batch(spark, rows, tmp_path, name):
    """Several micro-batches, a restart, and the marker at the end: no window is left behind."""
    given = random_events(17, n=250, span=200 * MIN)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    metric, schema = runs.METRICS[name], spark.createDataFrame([], SCHEMA).schema
    for chunk in in_order_chunks(given, 3):
        put(spark, source, chunk)

    def start():
        stream = drain.with_markers(parquet_stream(spark, source, schema, 1), root)
        return runs.start_metric(spark, name, metric(b.with_event_time(stream)), root, CONFIG)

    drain.run_and_drain(start, lambda: drain.put_marker(spark, root, schema))
    got = rows(result_table(spark, f"{root}/{name}", RESULT_TABLES[name][0]))
    assert got == rows(metric(b.with_event_time(spark.createDataFrame(given, SCHEMA))))
    drain.run_and_drain(start, lambda: drain.put_marker(spark, root, schema))      # once more changes nothing
    assert rows(result_table(spark, f"{root}/{name}", RESULT_TABLES[name][0])) == got


def test_state_of_the_funnel_holds_no_long_list(spark, rows, tmp_path):
    """One user has a third of the rows, hundreds of them in one second; no state row lists more than
    the events of a millisecond, or the summaries of one level."""
    given = random_events(18, n=600, span=2_000, grain=4)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, given)
    runs.start_metric(spark, "funnel_stats", funnel_stats(stream_of(spark, source)), root, CONFIG).awaitTermination()
    longest = {}
    for operator in range(4):
        sizes = [len(value) for r in state.state_rows(spark, f"{root}/_checkpoints/funnel_stats", operator).collect()
                 for value in r["value"].asDict().values() if isinstance(value, list)]
        longest[operator] = max(sizes, default=0)
    per_ms = Counter((u, t) for u, e, _, t, _ in given)
    # From the result to the source: totals, windows, seconds, milliseconds.
    assert longest[0] == 0 and longest[1] <= 300 and longest[2] <= 1000
    assert longest[3] <= max(per_ms.values()) < 20


def test_levels_of_the_funnel():
    from eventloom.operators.funnel import _between
    assert _between("1 millisecond", "5 minutes") == ["1 second"]
    assert _between("1 millisecond", "7 days") == ["1 second", "1 minute", "1 hour"]
    assert _between("1 second", "5 minutes") == [] and _between("5 minutes", "5 minutes") == []


def test_open_windows_of_a_stopped_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, source, [("u", "view", "/p", 1_000, 0), ("u", "view", "/p", 9 * MIN + 58_000, 1), ("v", "click", "/p", 10 * MIN, 2),
                        ("v", "click", "/p", 10 * MIN + 1, 3)])
    rows_ = b.events_per_type(stream_of(spark, source))
    runs.start_metric(spark, "events_per_type", rows_, root, CONFIG).awaitTermination()
    held = state.open_windows(spark, f"{root}/_checkpoints/events_per_type").collect()
    assert sorted(map(tuple, held)) == [("click", 10 * MIN, 11 * MIN, 2), ("view", 9 * MIN, 10 * MIN, 1)]


def test_progress_counts_what_was_set_aside(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    texts = ['{"userId":"u","event":"view","page":"/p","timestamp":5}', "{bad", '{"userId":"u"}', "", '{"userId":"v","event":"click","page":"/p","timestamp":6}']
    (tmp_path / "raw" / "a").write_text("\n".join(texts))
    raw = text_stream(spark, str(tmp_path / "raw")).selectExpr("value", "0L AS seq")
    first, second = runs.decode_events(spark, raw, str(tmp_path / "lake"), CONFIG)
    second.awaitTermination()
    seen = first.lastProgress["observedMetrics"]["decoded"]
    assert (seen["taken"], seen["not JSON"], seen["missing field"], seen["wrong type"]) == (2, 1, 1, 0)
    kept = spark.read.parquet(str(tmp_path / "lake" / "rejected")).collect()
    assert sorted((r.value, r.reason) for r in kept) == [('{"userId":"u"}', "missing field"), ("{bad", "not JSON")]


def test_compaction_changes_nothing_for_readers(spark, rows, tmp_path):
    path, day = str(tmp_path / "t"), 86_400_000
    schema, sort_by, day_of = RESULT_TABLES["page_views"]
    given = [("m", f"k{i * 7 % 5}", i * day // 20, 0, float(i)) for i in range(60)]
    load = lambda part, run: sinks.write_run(
        spark.createDataFrame(part, schema), path, f"{run:012d}", sort_by, "batch_id", day_of, files_per_day=2)
    read = lambda: rows(result_table(spark, path, schema))
    for run in range(3):
        load(given[run::3], run)
    assert read() == sorted(given) and manifest.versions(spark, path) == []
    prepared = manifest.prepare(spark, path, sort_by)
    assert read() == sorted(given)                      # files of both kinds are there
    assert manifest.publish(spark, path, prepared) == 1
    assert read() == sorted(given) and len(manifest.live_folders(spark, path)) == 3
    load(given[1::3], 1)                                # a run that is written again is in the compacted one
    assert read() == sorted(given)
    more = [("m", "later", day, 0, 9.0)]
    load(more, 3)
    assert read() == sorted(given + more)
    one = result_table(spark, path, schema, (date(1970, 1, 2), date(1970, 1, 2)))
    assert rows(one) == sorted(r for r in given + more if day <= r[2] < 2 * day)
    assert manifest.compact(spark, path, sort_by) == 2 and read() == sorted(given + more)
    assert manifest.compact(spark, path, sort_by) is None
    gone = manifest.vacuum(spark, path, keep=1)
    assert gone and read() == sorted(given + more)
    assert len(list((tmp_path / "t").glob("day=*/batch_id=*"))) == len(manifest.live_folders(spark, path)) == 3
    load([("m", "last", 2 * day, 0, 1.0)], 4)
    assert manifest.vacuum(spark, path, keep=1) == [] and len(read()) == 62


def test_late_rows_are_dropped_and_open_ones_kept(spark, rows, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = b.events_per_type(stream_of(spark, source))
        query = runs.start_metric(spark, "events_per_type", stream, root, CONFIG)
        query.awaitTermination()
        return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress
                   for op in progress["stateOperators"])

    event = lambda t, seq: ("u", "view", "/p", t, seq)
    put(spark, source, [event(1_000, 0)])
    assert run() == 0
    put(spark, source, [event(10 * MIN, 1)])
    assert run() == 0
    put(spark, source, [event(10 * MIN + 1, 2)])
    assert run() == 0
    put(spark, source, [event(2_000, 3), event(10 * MIN - 4_000, 4), event(10 * MIN + 2, 5)])
    assert run() == 1
    put(spark, source, [event(90 * MIN, 6)])
    run()
    got = rows(result_table(spark, f"{root}/events_per_type", RESULT_TABLES["events_per_type"][0]))
    assert [(r[2] // MIN, r[4]) for r in got] == [(0, 1.0), (9, 1.0), (10, 3.0)]


@pytest.mark.parametrize("name", ["session_stats", "funnel_stats", "conversion_rate"])
def test_restart_loses_and_repeats_nothing(spark, rows, tmp_path, name):
    given = random_events(13, n=200, span=120 * MIN)
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    metric = runs.METRICS[name]
    for chunk in in_order_chunks(given, 3) + [[("end", "view", "/p", 900 * MIN, 10_000)]]:
        put(spark, source, chunk)
        stream = metric(stream_of(spark, source))
        runs.start_metric(spark, name, stream, root, CONFIG).awaitTermination()
    got = rows(result_table(spark, f"{root}/{name}", RESULT_TABLES[name][0]))
    assert got == rows(metric(b.with_event_time(spark.createDataFrame(given, SCHEMA))))


def test_replayed_batch_replaces_itself(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1,), (2,)], "x bigint")
    second = spark.createDataFrame([(3,)], "x bigint")
    for batch, batch_id in ((first, "000000000000"), (second, "000000000001"),
                            (first, "000000000000")):
        sinks.write_run(batch, path, batch_id, ["x"], "batch_id")
    assert rows(spark.read.parquet(path).select("x")) == [(1,), (2,), (3,)]


def test_files_are_sorted_and_split_by_day(spark, rows, tmp_path):
    path, day = str(tmp_path / "t"), 86_400_000
    given = [("m", f"k{i * 7 % 5}", i * day // 4, 0, float(i)) for i in range(40)]
    schema, sort_by, day_of = RESULT_TABLES["page_views"]
    random.Random(1).shuffle(given)
    for _ in range(2):
        sinks.write_run(spark.createDataFrame(given, schema).coalesce(2), path, "0", sort_by,
                        "batch_id", day_of, files_per_day=2)
    files = sorted((tmp_path / "t").glob("day=*/batch_id=0/*.parquet"))
    assert len({f.parent.parent.name for f in files}) == 10
    assert len(files) <= 20
    for file in files:
        found = [tuple(r) for r in pq.read_table(file, partitioning=None).select(
            sort_by).to_pandas().itertuples(index=False)]
        assert found == sorted(found)
    assert rows(result_table(spark, path, schema)) == sorted(given)
    one = result_table(spark, path, schema, (date(1970, 1, 2), date(1970, 1, 2)))
    assert rows(one) == sorted(r for r in given if day <= r[2] < 2 * day)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_files_of_a_day_do_not_overlap(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    given = [("m", f"k{i % 97:02d}", i % 1000, 0, float(i)) for i in range(3000)]
    random.Random(2).shuffle(given)
    schema, sort_by, day_of = RESULT_TABLES["page_views"]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        sinks.write_run(spark.createDataFrame(given, schema), path, "0", sort_by, "batch_id", day_of)
    finally:
        spark.conf.unset(coalesce)
    ranges = []
    for file in (tmp_path / "t").glob("day=*/batch_id=0/*.parquet"):
        found = [tuple(r) for r in pq.read_table(file, partitioning=None).select(
            sort_by).to_pandas().itertuples(index=False)]
        ranges.append((min(found), max(found)))
    ranges.sort()
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert rows(result_table(spark, path, schema)) == sorted(given)


def test_user_behaviour_job_from_text(spark, rows, tmp_path):
    given = [e for e in random_events(14, n=150, span=60 * MIN)]
    # The file source gives no arrival order, so the text carries it as its line number.
    lines = [json.dumps({"seq": e[4], "body": json.dumps(dict(zip(COLUMNS[:4], e)))})
             for e in given + [("end", "view", "/p", 900 * MIN, 10_000)]]
    lines.insert(3, json.dumps({"seq": 20_000, "body": '{"userId":"broken"'}))
    lines.insert(9, json.dumps({"seq": 20_001, "body": "  "}))
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text("\n".join(lines))
    root = str(tmp_path / "lake")
    raw = text_stream(spark, str(tmp_path / "raw")).selectExpr(
        "get_json_object(value, '$.body') AS value",
        "CAST(get_json_object(value, '$.seq') AS bigint) AS seq")
    for query in runs.run_user_behaviour(spark, raw, root, CONFIG):
        query.awaitTermination()
        assert query.exception() is None
    assert spark.read.parquet(f"{root}/decoded").where("kind = 'event'").count() == len(given) + 1
    assert [r.value for r in spark.read.parquet(f"{root}/rejected").collect()] == [
        '{"userId":"broken"']
    events = b.with_event_time(spark.createDataFrame(given, SCHEMA))
    for name in runs.SEPARATE:
        metric = runs.METRICS[name]
        got = rows(result_table(spark, f"{root}/{name}", RESULT_TABLES[name][0]))
        assert got == rows(metric(events)), name


def test_user_behaviour_job_of_a_topic_that_ends(spark, rows, tmp_path):
    given = random_events(19, n=80, span=60 * MIN)
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.json").write_text("\n".join(
        json.dumps({"seq": e[4], "body": json.dumps(dict(zip(COLUMNS[:4], e)))}) for e in given))
    raw = text_stream(spark, str(tmp_path / "raw")).selectExpr(
        "get_json_object(value, '$.body') AS value", "CAST(get_json_object(value, '$.seq') AS bigint) AS seq")
    root, names = str(tmp_path / "lake"), ["events_per_type", "session_stats", "funnel_stats"]
    for query in runs.run_user_behaviour(spark, raw, root, CONFIG, names, drain=True):
        query.awaitTermination()
    events = b.with_event_time(spark.createDataFrame(given, SCHEMA))
    for name in names:
        assert rows(result_table(spark, f"{root}/{name}", RESULT_TABLES[name][0])) == rows(runs.METRICS[name](events)), name


def test_user_behaviour_job_keeps_running(spark, rows, tmp_path):
    """All streams start at once, before any event was decoded, and take what arrives later."""
    given = random_events(16, n=60, span=20 * MIN)
    raw_path, root = tmp_path / "raw", str(tmp_path / "lake")
    raw_path.mkdir()
    raw = text_stream(spark, str(raw_path)).selectExpr(
        "value", "CAST(get_json_object(value, '$.page') AS bigint) AS seq")
    queries = runs.run_user_behaviour(
        spark, raw, root, CONFIG, ["events_per_type", "retention"], available_now=False)
    try:
        for number, chunk in enumerate([given, [("end", "view", "/p", 900 * MIN, 10_000)]]):
            lines = [json.dumps(dict(zip(COLUMNS[:4], (u, e, str(seq), t))))
                     for u, e, _, t, seq in chunk]
            (tmp_path / "part").write_text("\n".join(lines))
            os.rename(tmp_path / "part", raw_path / f"{number}.json")
            for query in queries:
                query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    events = b.with_event_time(spark.createDataFrame(given, SCHEMA))
    for name in ("events_per_type", "retention"):
        got = rows(result_table(spark, f"{root}/{name}", RESULT_TABLES[name][0]))
        assert got == rows(runs.METRICS[name](events)), name


def change(device, temperature, second):
    at = datetime(2024, 1, 1) + timedelta(seconds=second)
    row = {"id": 1, "device_id": device, "temperature": temperature, "humidity": 1.0,
           "pressure": 2.0, "timestamp": None}
    value = json.dumps({"payload": {"before": None, "after": row, "op": "c", "ts_ms": 0}})
    return (value, at)


def test_sensor_job_emits_every_refinement(spark, rows, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "lake")
    schema = "value string, record_time timestamp"
    batches = [[change("d", 20.0, 1)], [change("d", 22.0, 2)],
               [change("d", 24.0, 3), change("e", 5.0, 12)]]
    for given in batches:
        spark.createDataFrame(given, schema).coalesce(1).write.mode("append").parquet(source)
        changes = parquet_stream(spark, source, spark.createDataFrame([], schema).schema, 1)
        runs.run_sensors(spark, changes, root, CONFIG).awaitTermination()
    table = result_table(spark, f"{root}/sensor_aggregates", RESULT_TABLES["sensor_aggregates"][0])
    assert sorted((r["device_id"], r["count"]) for r in table.collect()) == [
        ("d", 1), ("d", 2), ("d", 3), ("e", 1)]
    everything = spark.createDataFrame([c for given in batches for c in given], schema)
    want = sensors.sensor_aggregates(parse_cdc(everything))
    assert rows(sensors.latest_per_window(table)) == rows(want)


@pytest.mark.parametrize("name", list(runs.METRICS))
def test_result_topic_into_table(spark, rows, tmp_path, name):
    """Metric rows as topic messages, loaded into the metric's table."""
    schema, order, _ = RESULT_TABLES[name]
    data = b.with_event_time(spark.createDataFrame(random_events(15, n=80), SCHEMA))
    result = runs.METRICS[name](data)
    messages = sinks.topic_records(result, key=order[:1])
    messages.select("value").write.text(str(tmp_path / "topic"))
    topic = text_stream(spark, str(tmp_path / "topic"))
    for query in runs.run_loads({name: topic}, str(tmp_path / "lake")):
        query.awaitTermination()
    assert rows(result_table(spark, str(tmp_path / "lake" / name), schema)) == rows(result)


def test_topic_records(spark):
    df = spark.createDataFrame([("a", None, 1)], "k string, n string, v bigint")
    row = sinks.topic_records(df, key=["k", "v"]).first()
    assert (row.key, row.value) == ("a@1", '{"k":"a","n":null,"v":1}')
    assert sinks.topic_records(df, ignore_nulls=True).first().value == '{"k":"a","v":1}'
    assert sinks.topic_records(df).first().key is None


def test_jdbc_options():
    options = sinks.jdbc_options("jdbc:x", "log_events", driver="d", connections=4)
    assert options == {"url": "jdbc:x", "dbtable": "log_events", "driver": "d",
                       "batchsize": "10000", "numPartitions": "4"}


def test_state_rows_are_not_counted(spark, tmp_path):
    """A count of state rows costs a look-up with every write; the session's own setting comes back."""
    path, name = str(tmp_path / "in"), "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
    put(spark, path, random_events(50))
    before = spark.conf.get(name, None)
    query = runs.start_metric(spark, "retention", b.retention(stream_of(spark, path)), str(tmp_path / "out"), CONFIG)
    query.awaitTermination()
    assert max(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]) > 0
    assert all(op["numRowsTotal"] <= 0 for p in query.recentProgress for op in p["stateOperators"])
    assert spark.conf.get(name, None) == before
