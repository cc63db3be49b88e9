"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query is computed in full (no-op sink): one warm-up, then the median of the timed runs.
Streams, which write their tables, are run once, after one of them as a warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from eventloom.catalog.queries import QUERIES
from eventloom.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ONCE = ("stream_",)

# Not timed: panels and charts repeat a metric query with a projection, loads repeat one through a
# topic's files, and these repeat a query with other settings.
SKIP = ("panel_", "chart_", "load_")
VARIANTS = {
    "unique_users_per_page_1d", "session_stats_6h", "activity_heatmap_1d", "retention_1d",
    "sensor_aggregates_1d", "user_paths_short_parts", "service_p99_month",
    "traces_per_service_range", "log_series", "rejected_user_events", "parse_user_events_strict",
    "date_filter_zoned", "date_time_filter_zoned", "stream_conversion_rate_wide", "stream_funnel_stats_7d",
    "stream_late_rows", "stream_open_windows", "stream_bounded_batches", "stream_compacted_table",
    "trace_times_stored", "merged_users_range", "merged_p99_day", "merged_p99_week",
}


def headline() -> list[str]:
    return [name for name in QUERIES if not name.startswith(SKIP) and name not in VARIANTS]


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
    })
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timed("stream_retention")
    seconds = {}
    for name in headline():
        runs = 1 if name.startswith(ONCE) else RUNS
        if runs > 1:
            timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
