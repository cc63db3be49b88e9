"""What the plans must look like to hold at size."""

import re

import pytest
from conftest import DATA

import __spark_entry__ as contract

QUERIES = contract.queries()
SMALL = f"{DATA}/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_no_python_and_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not re.search("Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", ["time_filter", "time_filter_ms", "date_time_filter",
                                  "conditional_all", "adhoc_filter"])
def test_filters_reach_the_scan(spark, name):
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan_of(QUERIES[name](spark, SMALL))).group(1)
    assert re.search("GreaterThanOrEqual|In\\(|EqualTo", pushed), pushed


@pytest.mark.parametrize("name,columns", [
    ("events_per_type", {"ts", "event_type"}), ("retention", {"ts", "user_id"}),
    ("session_stats", {"ts", "user_id"}), ("activity_heatmap", {"ts"}),
    ("service_names", {"l_returnflag"}), ("events_by_device", {"props"}),
])
def test_scans_read_only_what_is_used(spark, name, columns):
    schema = re.search(r"ReadSchema: struct<(.*?)>", plan_of(QUERIES[name](spark, SMALL))).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == columns


@pytest.mark.parametrize("name,exchanges", [
    ("events_per_type", 1), ("page_views", 1), ("count_metrics", 1), ("log_reports", 1),
    ("retention", 2), ("session_stats", 2), ("conversion_rate", 3), ("service_p99_approx", 1),
])
def test_shuffles(spark, name, exchanges):
    plan = plan_of(QUERIES[name](spark, SMALL)).split("Initial Plan")[0]
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == exchanges


@pytest.mark.parametrize("name", ["funnel_stats", "service_p99", "user_paths"])
def test_first_passes_are_shared(spark, name):
    df = QUERIES[name](spark, SMALL)
    df.collect()
    assert "Reused" in plan_of(df)


def test_no_window_orders_all_rows_of_a_user(spark):
    plan = plan_of(QUERIES["user_paths"](spark, SMALL))
    windows = re.findall(r"Window \[row_number\(\).*?\], \[([^\]]*)\]", plan)
    assert windows and all("slice" in keys for keys in windows)


def test_range_of_a_stored_panel_reaches_the_partitions(spark):
    plan = plan_of(QUERIES["panel_retention_range"](spark, SMALL))
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan)


def test_slowest_traces_are_the_only_broadcast(spark):
    plan = plan_of(QUERIES["trace_list"](spark, SMALL))
    assert "BroadcastHashJoin" in plan and "TakeOrderedAndProject(limit=100" in plan
