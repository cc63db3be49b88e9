"""A store of spans with a stored index of the time that each trace takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.traces import trace_detail, trace_time_index
from eventloom.schemas import SPAN, TRACE_TIMES

#: Rows that a task sorts, about: spans are some 450 bytes each in memory, entries of the index some 80.
_SPANS_A_PART, _ENTRIES_A_PART = 250_000, 1_000_000


def load_spans(spans: DataFrame, root: str, run_id: str) -> None:
    """One run of spans into the store; loading it again replaces it.

    Spans are split by month and lie in time order, in files that do not overlap, so that a moment is in
    one month's folder and in few files of it. The run's part of the index comes from the stored spans,
    sorted by trace and with Bloom filters, so that a look-up opens the pages of one trace only. A trace
    whose spans come in several runs has an entry in each; look-ups take the widest.

    Rows are counted first and dealt out in as many ranges as that asks for. Left to itself Spark joins
    ranges by their compressed size, and one range unpacked does not fit a task's memory. Equal times may
    lie in several ranges, so that a moment with very many spans is no task of its own.
    """
    spark, parts, rows_in = spans.sparkSession, ["month", "run_id"], spans.count()
    rows = spans.withColumns({"month": F.trunc("Timestamp", "month"), "run_id": F.lit(run_id)})
    (
        rows.repartitionByRange(_ranges(rows_in, _SPANS_A_PART), "Timestamp", "TraceId")
        .sortWithinPartitions(*parts, "Timestamp")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{root}/spans")
    )
    stored = stored_spans(spark, root).where(F.col("run_id") == run_id)
    (
        trace_time_index(stored).withColumn("run_id", F.lit(run_id))
        .repartitionByRange(_ranges(rows_in, _ENTRIES_A_PART), "TraceId").sortWithinPartitions("run_id", "TraceId")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.enabled#TraceId", "true").partitionBy("run_id").parquet(f"{root}/trace_times")
    )


def _ranges(rows: int, per_range: int) -> int:
    return max(1, -(-rows // per_range))


def stored_spans(spark: SparkSession, root: str) -> DataFrame:
    """The spans with their `month` and `run_id`, by which the files are split."""
    return spark.read.schema(f"{_ddl(SPAN)}, month date, run_id string").parquet(f"{root}/spans")


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def trace_times(spark: SparkSession, root: str, trace_id: str | None = None) -> DataFrame:
    """`TraceId`, `Start`, `End` over all runs, of one trace or of all."""
    index = spark.read.schema(f"{_ddl(TRACE_TIMES)}, run_id string").parquet(f"{root}/trace_times")
    if trace_id is not None:
        index = index.where(F.col("TraceId") == trace_id)
    return index.groupBy("TraceId").agg(F.min("Start").alias("Start"), F.max("End").alias("End"))


def stored_trace_detail(spark: SparkSession, root: str, trace_id: str, limit: int = 1_000) -> DataFrame:
    """The timed spans of one trace: the index gives its time, and only files of that time are read."""
    spans = stored_spans(spark, root).drop("run_id")
    return trace_detail(spans, trace_id, trace_times(spark, root, trace_id), limit=limit)
