"""Sinks: topics, relational tables and lake tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventloom.config import JobConfig
from eventloom.functions.jsontext import to_json_text


def topic_records(df: DataFrame, key: Sequence[str] = (), ignore_nulls: bool = False) -> DataFrame:
    """Rows as (key, value) text: the whole row as JSON, the key columns joined."""
    value = to_json_text(df.columns, keep_nulls=not ignore_nulls).alias("value")
    if not key:
        return df.select(F.lit(None).cast("string").alias("key"), value)
    return df.select(F.concat_ws("@", *key).alias("key"), value)


def to_topic(records: DataFrame, config: JobConfig, topic: str, checkpoint: str,
             output_mode: str = "append", available_now: bool = False) -> StreamingQuery:
    """Send (key, value) records to a topic; needs the Kafka connector on the class path."""
    writer = (
        records.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", config.bootstrap).option("topic", topic)
        .option("checkpointLocation", checkpoint).outputMode(output_mode)
    )
    return writer.trigger(**config.trigger(available_now)).start()


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 driver: str | None = None, batch_rows: int = 10_000,
                 connections: int = 16) -> dict[str, str]:
    """Options of a table load. Each partition is one connection and one transaction."""
    given = {"url": url, "dbtable": table, "user": user, "password": password, "driver": driver,
             "batchsize": str(batch_rows), "numPartitions": str(connections)}
    return {name: value for name, value in given.items() if value is not None}


def to_jdbc(df: DataFrame, options: dict[str, str], mode: str = "append") -> None:
    """Load a relational table. `append` repeats rows when the same input is loaded again;
    `overwrite` empties the table first and keeps its definition."""
    df.write.mode(mode).format("jdbc").options(**options).option("truncate", "true").save()


def _day_of(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    time = F.timestamp_millis(column) if isinstance(kind, T.LongType) else F.col(column)
    return F.to_date(time)


def write_run(df: DataFrame, path: str, run_id: str, sort_by: Sequence[str] = (),
              run_column: str = "run_id", day_of: str | None = None,
              files_per_day: int | None = None, skip_empty: bool = False) -> None:
    """Write one run of a load into partitions of its own; writing the run again replaces them.

    Files are kept in `sort_by` order. With `day_of` the run is also split by the day of that column,
    so that a read of some days lists only those; rows are first dealt out in ranges of day and sort
    key, in as many parts as the run's size asks for, so the files of a day do not overlap. The rows
    are held meanwhile, because ranges are found by a first pass over them. `files_per_day` sets the
    number of files instead, for small runs; rows are then dealt out evenly. With `skip_empty` held rows
    are counted first, and a run without any, as most micro-batches between two windows are, costs no more.
    """
    out, parts, held = df.withColumn(run_column, F.lit(run_id)), [run_column], None
    if day_of is not None:
        out, parts = out.withColumn("day", _day_of(df, day_of)), ["day", run_column]
        if files_per_day is None:
            held = out.persist()
            out = held.repartitionByRange("day", *sort_by)
            if skip_empty and not held.count():
                held.unpersist()
                return
        else:
            out = out.repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(files_per_day)))
    try:
        (
            out.sortWithinPartitions(*parts, *sort_by)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts).parquet(path)
        )
    finally:
        if held is not None:
            held.unpersist()


def to_table(stream: DataFrame, path: str, checkpoint: str, sort_by: Sequence[str] = (),
             day_of: str | None = None, files_per_day: int | None = None, output_mode: str = "append",
             available_now: bool = True, config: JobConfig | None = None) -> StreamingQuery:
    """Continuous load of a table: every micro-batch is a run, so a replayed batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_run(batch, path, f"{batch_id:012d}", sort_by, "batch_id", day_of, files_per_day, skip_empty=True)

    writer = stream.writeStream.foreachBatch(write).outputMode(output_mode).option(
        "checkpointLocation", checkpoint)
    return writer.trigger(**(config or JobConfig()).trigger(available_now)).start()


def topic_table(messages: DataFrame, schema: T.StructType, path: str, checkpoint: str,
                sort_by: Sequence[str] = (), day_of: str | None = None, files_per_day: int | None = None,
                value: str = "value", available_now: bool = True,
                config: JobConfig | None = None) -> StreamingQuery:
    """Topic of JSON rows into a table."""
    rows = messages.select(F.from_json(value, schema).alias("r")).select("r.*")
    return to_table(
        rows, path, checkpoint, sort_by, day_of, files_per_day, available_now=available_now, config=config)
