"""Topic readers. They need the Kafka connector on the class path, which Spark does not ship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import JobConfig


def topic_options(config: JobConfig, topic: str) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": config.bootstrap,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }
    if config.offsets_per_batch:
        options["maxOffsetsPerTrigger"] = str(config.offsets_per_batch)
    return options


def topic_stream(spark: SparkSession, config: JobConfig, topic: str) -> DataFrame:
    """Text records of a topic: value, record time, and the arrival order `seq`."""
    records = spark.readStream.format("kafka").options(**topic_options(config, topic)).load()
    return topic_rows(records)


def topic_rows(records: DataFrame) -> DataFrame:
    """`seq` is the offset, told apart by partition (order between partitions means nothing)."""
    seq = F.shiftleft(F.col("partition").cast("bigint"), 48) + F.col("offset")
    return records.select(
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("record_time"),
        seq.alias("seq"))
