"""Batch log job: one read, all reports, one load."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.operators import logs
from eventloom.sources.decode import parse_logs
from eventloom.sources.files import json_lines
from eventloom.streaming.sinks import to_jdbc, write_run

REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "events_by_type": logs.events_by_type,
    "errors_by_type": logs.errors_by_type,
    "events_per_minute": logs.events_per_minute,
    "product_views_by_category": logs.product_views_by_category,
    "events_by_device": logs.events_by_device,
}


def run_logs(spark: SparkSession, path: str, table_path: str, run_id: str,
             jdbc: dict[str, str] | None = None, jdbc_mode: str = "append") -> dict[str, DataFrame]:
    """Decode a log file, load it as one run and return the reports over that run.

    The text is decoded once: the reports read the loaded columnar run, where each scans only its
    own column. Loading a run again replaces it. With `jdbc` options the rows also go to a
    relational table; `jdbc_mode="overwrite"` empties it first, so that a rerun repeats nothing.
    """
    lines = parse_logs(json_lines(spark, path))
    write_run(lines, table_path, run_id, ["timestamp"])
    declared = T.StructType([*lines.schema.fields, T.StructField("run_id", T.StringType())])
    run = spark.read.schema(declared).parquet(table_path).where(F.col("run_id") == run_id).drop("run_id")
    if jdbc:
        to_jdbc(run, jdbc, jdbc_mode)
    reports = {name: report(run) for name, report in REPORTS.items()}
    reports["user_paths"] = logs.user_paths(run, order=("timestamp", "sessionId"))
    return reports
