"""Stored sketches and the trace store: errors, merging, and what a look-up reads."""

import random
import re
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import difference
from eventloom.catalog.oracle import ORACLE
from eventloom.catalog.queries import QUERIES
from eventloom.operators import behaviour as b
from eventloom.operators import sketches, traces
from eventloom.operators.funnel import funnel_stats
from eventloom.plans import trace_store
from eventloom.schemas import SPAN
from test_behaviour import MIN, SCHEMA
from test_plans import plan_of

T0 = datetime(2024, 1, 1)


def test_merged_users_are_within_the_error(spark):
    """30,000 users a page, spread over minutes, many of them in several."""
    events = spark.range(200_000).select(
        F.concat(F.lit("u"), F.pmod(F.hash("id"), F.lit(30_000))).alias("userId"), F.lit("view").alias("event"),
        F.concat(F.lit("/p"), F.pmod("id", F.lit(2))).alias("page"), (F.pmod(F.xxhash64("id"), F.lit(120)) * MIN).alias("timestamp"))
    events = b.with_event_time(events)
    stored = sketches.user_sketches(events)
    exact = {r.key: r.value for r in b.unique_users_per_page(events, "2 hours").collect()}
    found = {r.key: r.value for r in sketches.merged_users(stored, "2 hours").collect()}
    assert exact.keys() == found.keys() and all(abs(found[k] / exact[k] - 1) < 0.04 for k in exact)
    whole = {r.key: r.value for r in sketches.merged_users(stored).collect()}
    assert whole == found
    hour = sketches.merged_users(stored, None, (datetime(1970, 1, 1), datetime(1970, 1, 1, 0, 59))).collect()
    per_hour = {r.key: r.value for r in b.unique_users_per_page(events, "1 hour").where("windowStart = 0").collect()}
    assert {r.key for r in hour} == per_hour.keys() and all(abs(r.value / per_hour[r.key] - 1) < 0.04 for r in hour)


@pytest.mark.parametrize("name", ["merged_users_1d", "merged_users_range"])
def test_merged_users_of_large_groups_are_exact(spark, tmp_path, name):
    """30,000 users on each of two pages; half of them come again on the next day."""
    n = F.col("id")
    spark.range(120_000).select(
        n.alias("event_id"),
        F.timestamp_micros(F.lit(1_704_931_200_000_000) + n * 1_000_000).cast("timestamp_ntz").alias("ts"),
        F.when(n % 1009 != 0, F.pmod(n, F.lit(60_000)) + F.when(n < 60_000, 0).otherwise(30_000)).alias("user_id"),
        F.lit("view").alias("event_type"), n.cast("double").alias("value"),
        F.concat(F.lit('{"k": '), n % 2, F.lit("}")).alias("props"),
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert difference(QUERIES[name](spark, str(tmp_path)), con, ORACLE[name]) is None


def spans(spark, n=20_000):
    rng = random.Random(3)
    given = [(T0 + timedelta(seconds=rng.randrange(10 * 86_400)), f"t{i % 4000}", f"s{i}", "", rng.choice("ab"), "op",
              int(rng.paretovariate(1.2) * 1e6), "Ok", {}, {}) for i in range(n)]
    return spark.createDataFrame(given, SPAN), given


def test_merged_quantiles_are_within_the_error(spark):
    df, given = spans(spark)
    found = sketches.merged_quantile(sketches.latency_sketches(df, 3600), 5 * 86_400).collect()
    assert found
    for r in found:
        start = r.time
        values = sorted(g[6] for g in given if g[4] == r.ServiceName and start <= g[0] < start + timedelta(days=5))
        rank = sum(v <= r.p99 * 1e6 + 1 for v in values) / len(values)
        assert abs(rank - 0.99) < 0.005
    assert sketches.merged_quantile(sketches.latency_sketches(df, 3600), 86_400, limit=3).count() == 3


def test_look_up_reads_the_time_of_one_trace(spark, tmp_path):
    df, given = spans(spark, 8000)
    root = str(tmp_path / "store")
    for run in (0, 1, 1):       # the second is loaded twice
        trace_store.load_spans(df.where(F.pmod(F.hash("SpanId"), F.lit(2)) == run), root, f"r{run}")
    assert trace_store.stored_spans(spark, root).count() == len(given)
    times = {r.TraceId: (r.Start, r.End) for r in trace_store.trace_times(spark, root).collect()}
    assert times == {r.TraceId: (r.Start, r.End) for r in traces.trace_time_index(df).collect()}
    detail = trace_store.stored_trace_detail(spark, root, "t17")
    assert [r.spanID for r in detail.collect()] == [r.spanID for r in traces.trace_detail(df, "t17").collect()]
    plan = plan_of(detail)
    scans = re.findall(r"FileScan parquet.*", plan)
    scan = next(s for s in scans if "ParentSpanId" in s)
    assert re.search(r"PartitionFilters: \[[^\]]*month#\d+ >= .*Subquery", scan)
    assert "Timestamp" in re.search(r"PushedFilters: \[(.*?)\]", scan).group(1)
    assert "TraceId" in re.search(r"PushedFilters: \[(.*?)\]", next(s for s in scans if "trace_times" in s or "Start" in s)).group(1)
    # Only the index is aggregated; of the spans nothing is grouped.
    assert not re.search(r"Aggregate.*SpanId", plan)
    assert trace_store.stored_trace_detail(spark, root, "nobody").collect() == []


def test_spans_are_sorted_in_parts_that_follow_their_number(spark, tmp_path, monkeypatch):
    """2,000 spans, a third of them at one moment, of 100 rows a part; the index of 700 traces of 100, too."""
    monkeypatch.setattr(trace_store, "_SPANS_A_PART", 100)
    monkeypatch.setattr(trace_store, "_ENTRIES_A_PART", 100)
    given = [(T0 + timedelta(hours=i if i % 3 else 0), f"t{i % 700}", f"s{i}", "", "a", "op", 1, "Ok", {}, {}) for i in range(2000)]
    root = str(tmp_path / "store")
    trace_store.load_spans(spark.createDataFrame(given, SPAN), root, "r")
    for table, rows, files in (("spans", 2000, 15), ("trace_times", 700, 15)):
        held = spark.read.parquet(f"{root}/{table}").groupBy(F.input_file_name()).count().collect()
        assert sum(r["count"] for r in held) == rows and len(held) >= files
        assert max(r["count"] for r in held) <= 300
    assert trace_store.trace_times(spark, root).count() == 700


def test_hot_user_of_the_batch_funnel(spark, rows):
    """One user has a third of the clicks; view and purchase lie close together in the middle of them."""
    hot = [("hot", "click", "/p", t, t) for t in range(0, 300_000, 25)]
    hot += [("hot", "view", "/p", 150_001, 400_000), ("hot", "purchase", "/p", 150_020, 400_001)]
    mid = [("mid", "click", "/p", 100, 1), ("mid", "view", "/p", 101, 2), ("mid", "click", "/p", 101, 3),
           ("mid", "purchase", "/p", 101, 4), ("mid", "click", "/p", 102, 5)]
    none = [("none", "click", "/p", 100, 1), ("none", "view", "/p", 101, 2), ("none", "purchase", "/p", 101, 4), ("none", "click", "/p", 102, 5)]
    df = b.with_event_time(spark.createDataFrame(hot + mid + none, SCHEMA))
    assert rows(funnel_stats(df)) == [(0, 300_000, 3, 3, 3, 3, 1, 1)]
    closer = hot[:-2] + [("hot", "view", "/p", 150_001, 400_000), ("hot", "purchase", "/p", 150_026, 400_001)]
    df = b.with_event_time(spark.createDataFrame(closer, SCHEMA))
    assert rows(funnel_stats(df)) == [(0, 300_000, 1, 1, 1, 1, 1, 1)]
