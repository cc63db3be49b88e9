"""Command line of the jobs: `spark-submit … eventloom/jobs.py behaviour|sensors|load|logs …`."""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventloom.config import JobConfig, shared_dir
from eventloom.plans.logs import run_logs
from eventloom.session import build_session
from eventloom.sources.topics import topic_stream
from eventloom.streaming import runs
from eventloom.streaming.sinks import jdbc_options


def arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="eventloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("behaviour", "sensors"):
        stream = jobs.add_parser(name)
        stream.add_argument("--root", help="folder of the tables; default: under the shared folder")
        stream.add_argument("--bootstrap", help="brokers; default: KAFKA_BOOTSTRAP")
        stream.add_argument("--publish", action="store_true", help="also send results to topics")
        stream.add_argument("--once", action="store_true", help="stop when the topic is read up")
        if name == "behaviour":
            stream.add_argument("--drain", action="store_true",
                                help="with --once: the topic ends here, so emit its open windows too")
        _add_limits(stream)
    load = jobs.add_parser("load")
    load.add_argument("--root", help="folder of the tables; default: under the shared folder")
    load.add_argument("--bootstrap", help="brokers; default: KAFKA_BOOTSTRAP")
    load.add_argument("--tables", nargs="+", choices=runs.LOADED, default=list(runs.LOADED))
    load.add_argument("--once", action="store_true", help="stop when the topics are read up")
    _add_limits(load)
    logs = jobs.add_parser("logs")
    logs.add_argument("--input", required=True, help="JSON-lines file or folder")
    logs.add_argument("--table", required=True, help="folder of the log table")
    logs.add_argument("--run-id", required=True, help="loading a run again replaces it")
    logs.add_argument("--jdbc-url", help="also load the lines into a relational table at this address")
    logs.add_argument("--jdbc-table", default="log_events")
    logs.add_argument("--jdbc-driver", help="class of the driver")
    logs.add_argument("--jdbc-mode", choices=("append", "overwrite"), default="append",
                      help="append repeats rows when a run is loaded again; overwrite empties the table")
    args = parser.parse_args(argv)
    if getattr(args, "drain", False) and not args.once:
        parser.error("--drain needs --once")
    return args


def _add_limits(parser: argparse.ArgumentParser) -> None:
    parser.add_argument("--offsets-per-batch", type=int, help="records of a topic in a micro-batch, at most")
    parser.add_argument("--files-per-batch", type=int, help="files of a table in a micro-batch, at most")
    parser.add_argument("--batch-interval", help="pause between micro-batches, such as '30 seconds'")


def config_of(args: argparse.Namespace) -> JobConfig:
    """The settings of the environment, with what the command line names instead."""
    named = ("bootstrap", "offsets_per_batch", "files_per_batch", "batch_interval")
    return JobConfig(**{n: getattr(args, n) for n in named if getattr(args, n, None)})


def wait_for_all(spark: SparkSession, queries: Sequence[StreamingQuery]) -> None:
    """Until all have ended. As soon as one fails the others are stopped, and its error is raised."""
    try:
        while any(query.isActive for query in queries):
            spark.streams.awaitAnyTermination()
            spark.streams.resetTerminated()
        for query in queries:
            if query.exception() is not None:
                raise query.exception()
    finally:
        for query in queries:
            query.stop()


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "logs":
        jdbc = None
        if args.jdbc_url:
            # Credentials come from the environment, so that they stand in no process list.
            jdbc = jdbc_options(args.jdbc_url, args.jdbc_table, os.environ.get("JDBC_USER"),
                                os.environ.get("JDBC_PASSWORD"), args.jdbc_driver)
        reports = run_logs(spark, args.input, args.table, args.run_id, jdbc, args.jdbc_mode)
        for report in reports.values():
            report.show(20, truncate=False)
        return
    config = config_of(args)
    root = args.root or f"{shared_dir(spark)}/{args.job}"
    if args.job == "load":
        topics = {name: config.sensor_topic if name == "sensor_aggregates" else name for name in args.tables}
        messages = {name: topic_stream(spark, config, topic) for name, topic in topics.items()}
        queries = runs.run_loads(messages, root, config, available_now=args.once)
    elif args.job == "behaviour":
        raw = topic_stream(spark, config, config.events_topic)
        queries = runs.run_user_behaviour(
            spark, raw, root, config, available_now=args.once, drain=args.drain)
        if args.publish:
            events = runs.event_table_stream(spark, root)
            queries += runs.publish_metrics(
                spark, events, f"{root}/_topics", config, available_now=args.once)
    else:
        changes = topic_stream(spark, config, config.cdc_topic)
        queries = [runs.run_sensors(spark, changes, root, config, available_now=args.once)]
        if args.publish:
            queries.append(runs.publish_sensors(
                spark, changes, f"{root}/_topics", config, available_now=args.once))
    wait_for_all(spark, queries)


if __name__ == "__main__":
    run(build_session(), arguments())
