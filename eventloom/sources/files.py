"""File readers: JSON lines, text, and result tables, as batches or as streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from eventloom.functions.predicates import date_filter
from eventloom.schemas import LOG_LINE
from eventloom.sources.manifest import live_table


def json_lines(spark: SparkSession, path: str, schema: T.StructType = LOG_LINE) -> DataFrame:
    """JSON-lines file with a declared schema, so that reading needs no inference scan."""
    return spark.read.schema(schema).json(path)


def put_file_data(df: DataFrame, path: str) -> None:
    """Put a data set into the lake as JSON lines, replacing what was there."""
    df.write.mode("overwrite").json(path)


def text_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of the files that arrive under `path`, as a column `value`."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   files_per_batch: int | None = None) -> DataFrame:
    """Parquet files that arrive under `path`; the schema is read once where none is given."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def result_table(spark: SparkSession, path: str, schema: T.StructType,
                 days: tuple[date, date] | None = None) -> DataFrame:
    """A table written by `streaming.sinks.to_table`; the load bookkeeping is left out.

    `days` (first, last) lists only those days' files of a table that is split by day. Of a table that
    was compacted the folders that its newest manifest leaves alive are read.
    """
    table = live_table(spark, path, days)
    if table is None:
        table = spark.read.parquet(path)
    if days is not None:
        table = date_filter(table, "day", *days)
    return table.select(*schema.fieldNames())
