"""What a stopped stream still holds in its state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def state_rows(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """`key` and `value` of every state row of one stateful operator, as of its last batch.

    Operators count from 0, the one nearest to the result; the rows are read in parallel, a task per
    state partition, and the stream must not be running.
    """
    rows = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    return rows.select("key", "value")


def open_windows(spark: SparkSession, checkpoint: str, key: str = "key") -> DataFrame:
    """`key`, `windowStart`, `windowEnd`, `n` of the windows of a windowed count that are still open.

    These are the windows that the watermark has not passed: a restart goes on counting in them.
    """
    rows = state_rows(spark, checkpoint)
    fields = rows.schema["key"].dataType.fieldNames()
    window = next(f for f in fields if rows.schema["key"].dataType[f].dataType.typeName() == "struct")
    named = next(f for f in fields if f != window)
    count = rows.schema["value"].dataType.fieldNames()[0]
    return rows.select(
        F.col("key")[named].alias(key), F.unix_millis(F.col("key")[window]["start"]).alias("windowStart"),
        F.unix_millis(F.col("key")[window]["end"]).alias("windowEnd"), F.col("value")[count].alias("n"))
