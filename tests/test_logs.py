"""Log reports, charts, user paths."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from eventloom import jobs
from eventloom.operators import logs
from eventloom.plans.logs import run_logs
from eventloom.sources.files import put_file_data

T0 = datetime(2024, 1, 1)
SCHEMA = "userId string, event string, timestamp timestamp, seq bigint"


def random_log(seed, n=600):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        user = "hot" if rng.random() < 1 / 3 else f"u{rng.randrange(40)}"
        out.append((user, rng.choice("abc"), T0 + timedelta(seconds=rng.randrange(9000)), seq))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("part_rows,slice", [(10_000, "1 minute"), (7, "1 hour"), (7, "1 second"), (1, "1 day")])
def test_paths_stay_whole(spark, part_rows, slice):
    given = random_log(1)
    given.append((None, "z", T0, 10_000))
    want = defaultdict(list)
    for user, event, time, seq in sorted(given, key=lambda r: (r[2], r[3])):
        want[user].append(event)
    got = defaultdict(dict)
    data = spark.createDataFrame(given, SCHEMA)
    for r in logs.user_paths(data, part_rows, slice).collect():
        assert len(r.events) <= part_rows
        assert r.part not in got[r.userId]
        got[r.userId][r.part] = r.events
    joined = {u: [e for _, part in sorted(p.items()) for e in part] for u, p in got.items()}
    assert joined == dict(want)
    for parts in got.values():
        assert sorted(parts) == list(range(len(parts)))


LINES = [
    # level, event, errorType, category, minute
    ("ERROR", "Payment failed", "card_declined", None, "2024-01-01 00:00"),
    ("ERROR", "Product viewed", "network_error", "books", "2024-01-01 00:01"),
    ("INFO", "Product viewed", None, "books", "2024-01-01 00:01"),
    ("INFO", "Product viewed", None, "toys", "2024-01-01 00:00"),
    ("ERROR", "Page viewed", "card_declined", None, "2024-01-01 00:00"),
]


@pytest.fixture()
def lines(spark):
    return spark.createDataFrame(
        LINES, "level string, event string, errorType string, category string, minute string")


def test_reports(lines, rows):
    assert [tuple(r) for r in logs.events_by_type(lines).collect()] == [
        ("Product viewed", 3), ("Page viewed", 1), ("Payment failed", 1)]
    assert rows(logs.errors_by_type(lines)) == [("card_declined", 2), ("network_error", 1)]
    assert [tuple(r) for r in logs.events_per_minute(lines).collect()] == [
        ("2024-01-01 00:00", 3), ("2024-01-01 00:01", 2)]
    assert rows(logs.product_views_by_category(lines)) == [("books", 2), ("toys", 1)]


def test_chart_keeps_missing_keys_and_cuts_in_key_order(lines):
    chart = lambda *a, **k: [tuple(r) for r in logs.chart_query(lines, *a, **k).collect()]
    assert chart(["errortype"]) == [(None, 2), ("card_declined", 2), ("network_error", 1)]
    assert chart(["errortype"], row_limit=1) == [(None, 2)]
    assert chart(["minute"], [("level", "==", "ERROR")]) == [
        ("2024-01-01 00:00", 2), ("2024-01-01 00:01", 1)]
    assert chart(["category"], [("event", "IN", ["Page viewed"])]) == [(None, 1)]
    assert chart(["level"], [("level", "!=", "ERROR")]) == [("INFO", 2)]
    with pytest.raises(ValueError):
        chart(["level"], metrics=["sum"])


def test_job_reruns_replace_their_run(spark, tmp_path, rows):
    entries = [("2024-01-01T10:20:30", "ERROR", "Payment failed", "u1", "s1", "mobile", "home",
                "card_declined", None, None, None),
               ("2024-01-01T10:20:10", "INFO", "Product viewed", "u1", "s2", "tablet", "home",
                None, None, "books", "p100")]
    from eventloom.schemas import LOG_LINE
    source, table = str(tmp_path / "in"), str(tmp_path / "log_events")
    put_file_data(spark.createDataFrame(entries, LOG_LINE), source)
    for run_id in ("h1", "h1"):
        jobs.run(spark, jobs.arguments(["logs", "--input", source, "--table", table,
                                        "--run-id", run_id]))
    reports = run_logs(spark, source, table, "h2")
    assert spark.read.parquet(table).count() == 4
    assert rows(reports["events_by_device"]) == [("mobile", 1), ("tablet", 1)]
    assert rows(reports["user_paths"]) == [("u1", 0, ["Product viewed", "Payment failed"])]
    assert rows(reports["errors_by_type"]) == [("card_declined", 1)]
