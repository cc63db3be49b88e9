"""Quantiles, trace panels and time-series helpers."""

import random
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import predicates as p
from eventloom.functions.quantiles import _fine_slice_of, _slice_of, approx_quantile, exact_quantile
from eventloom.operators import panels, traces
from eventloom.schemas import SPAN

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(9)
    groups = {
        "one": [7], "two": [1, 2], "same": [5] * 40, "edges": [0, 63, 64, 127, 128, 129, 255, 256],
        "wide": [2**k + d for k in range(1, 60) for d in (-1, 0, 1)],
        "hot": [rng.randrange(10**9) for _ in range(3000)],
        None: [3, 4, 9],
    }
    data = [(k, v) for k, values in groups.items() for v in values] + [("one", None)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, v bigint")
    got = {r.k: r.x for r in exact_quantile(df, ["k"], "v", q, "x").collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        want = np.quantile(np.array(values, dtype=float), q)
        assert got[k] == pytest.approx(want, rel=1e-9), k


def test_exact_quantile_of_many_values_in_one_group(spark):
    n = 300_000
    values = [(1 << 39) + i * 1_000_003 if i % 3 else i * 7 for i in range(n)]
    df = spark.range(n).select(
        F.lit("hot").alias("k"),
        F.when(F.col("id") % 3 != 0, F.lit(1 << 39) + F.col("id") * 1_000_003).otherwise(F.col("id") * 7).alias("v"))
    for q in (0.0, 1 / 3, 0.5, 0.99, 1.0):
        got = exact_quantile(df, ["k"], "v", q, "x").first().x
        assert got == pytest.approx(np.quantile(np.array(values, dtype=float), q), rel=1e-12)
    # Near 2^40 a slice that is looked at value by value spans 2^17 values.
    spans = spark.range(1 << 18).select((F.col("id") + (1 << 39)).alias("v")).select(
        _slice_of(F.col("v")).alias("s"), _fine_slice_of(F.col("v")).alias("f"))
    assert spans.groupBy("s", "f").count().agg(F.max("count")).first()[0] <= 1 << 17


def test_sketch_is_an_element_near_the_rank(spark):
    df = spark.range(20_000).withColumn("k", F.lit("a"))
    got = approx_quantile(df, ["k"], "id", 0.99, "x").first().x
    assert abs(got - 19_800) <= 4


def span(trace, span_id, second, duration, service="a", status="Ok", parent=""):
    return (T0 + timedelta(seconds=second), trace, span_id, parent, service, "op", duration, status,
            {"k": "v", "n": "1"}, {"host": "h"})


@pytest.fixture()
def spans(spark):
    return spark.createDataFrame([
        span("t1", "1", 5, 3_000_000), span("t1", "2", 1, 9_000_000, "b", "Error", "1"),
        span("t2", "3", 30, 5_000_000, "loadgenerator", "Error"),
        span("t3", "4", 70, 5_000_000, "a", "STATUS_CODE_ERROR"), span("t1", "5", 9, 0, "a"),
    ], SPAN)


def test_trace_list(spans):
    got = [tuple(r) for r in traces.trace_list(spans).collect()]
    assert got == [(T0 + timedelta(seconds=1), "t1", "b", 9.0),
                   (T0 + timedelta(seconds=70), "t3", "a", 5.0)]
    assert [r[1] for r in traces.trace_list(spans, limit=1).collect()] == ["t1"]
    assert [r[1] for r in traces.trace_list(spans, services=["a"], trace_ids=["t1"]).collect()] == [
        "t1"]


def test_trace_detail(spans):
    plain = traces.trace_detail(spans, "t1").collect()
    assert [(r.spanID, r.duration) for r in plain] == [("1", 3.0), ("2", 9.0)]
    tags = sorted(plain[0].tags, key=lambda t: t["key"])
    assert tags == [{"key": "k", "value": "v"}, {"key": "n", "value": "1"}]
    assert plain[0].serviceTags == [{"key": "host", "value": "h"}]
    indexed = traces.trace_detail(spans, "t1", traces.trace_time_index(spans)).collect()
    assert indexed == plain
    cut = traces.trace_detail(spans, "t1", time_range=(T0, T0 + timedelta(seconds=2)))
    assert [r.spanID for r in cut.collect()] == ["2"]


def test_status_codes(spans):
    assert [(r.spanID, r.statusCode) for r in traces.trace_spans(spans, "t1").collect()] == [
        ("2", 2), ("1", 0), ("5", 0)]
    assert traces.trace_spans(spans).count() == 5


def test_error_rate_and_counts(spans):
    minute = T0 + timedelta(seconds=60)
    assert [tuple(r) for r in traces.error_rate(spans, 60).collect()] == [
        (T0, "b", 1), (minute, "a", 1)]
    assert [tuple(r) for r in traces.traces_per_service(spans, 60, services=["a"]).collect()] == [
        (T0, "a", 2), (minute, "a", 1)]


def test_selectors(spans, rows):
    assert rows(traces.service_names(spans)) == [("a",), ("b",), ("loadgenerator",)]
    assert rows(traces.root_trace_ids(spans)) == [("t1",), ("t2",), ("t3",)]


def test_p99_forms_agree_on_small_groups(spans, rows):
    exact = rows(traces.service_p99(spans, 60, q=1.0, exact=True))
    assert exact == rows(traces.service_p99(spans, 60, q=1.0))


def test_filter_bounds(spark, rows):
    at = lambda ms: T0 + timedelta(milliseconds=ms)
    df = spark.createDataFrame([(i, at(i * 500)) for i in range(8)], "i int, t timestamp")
    ids = lambda out: [r[0] for r in rows(out.select("i"))]
    assert ids(p.time_filter(df, "t", at(1_700), at(3_000))) == [2, 3, 4, 5, 6]
    assert ids(p.time_filter_ms(df, "t", at(1_001), at(2_500))) == [3, 4, 5]
    aware = at(2_500).replace(tzinfo=timezone.utc)
    assert ids(p.time_filter_ms(df, "t", aware, aware)) == [5]
    days = df.withColumn("d", F.date_add(F.lit(date(2024, 1, 1)), F.col("i")))
    assert ids(p.date_filter(days, "d", date(2024, 1, 2), datetime(2024, 1, 3, 9))) == [1, 2]
    both = p.date_time_filter(days, "d", "t", T0, at(1_000))
    assert ids(both) == [0]
    epoch = df.withColumn("ms", F.unix_millis("t"))
    assert ids(p.time_filter_ms(epoch, "ms", at(500), at(500))) == [1]
    assert ids(p.adhoc_filters(df, {"i": 3})) == [3]
    assert p.conditional_all(df, F.col("i") == 1, None).count() == 8


def test_interval_starts(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 59, 730_000),)], "t timestamp")
    row = df.select(p.time_interval(F.col("t"), 20).alias("s"),
                    p.time_interval_ms(F.col("t"), 20).alias("m")).first()
    assert row.s == datetime(2024, 1, 1, 0, 0, 40)
    assert row.m == datetime(2024, 1, 1, 0, 0, 59, 720_000)


def test_heatmap_grid(spark):
    ms = 1_704_067_200_000
    df = spark.createDataFrame(
        [("activity_heatmap", "0", ms, ms + 60_000, 2.0), ("activity_heatmap", "5", ms, ms, 3.0)],
        "metric string, key string, windowStart bigint, windowEnd bigint, value double")
    row = panels.heatmap_grid(df).first()
    assert (row.time, row["0"], row["5"], row["6"]) == (T0, 2.0, 3.0, None)
