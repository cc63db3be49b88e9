"""Sensor averages per device and short window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.jsontext import to_json_text
from eventloom.functions.timeparts import iso_seconds

READING = ("avg_temp", "avg_humidity", "avg_pressure", "count")


def sensor_aggregates(df: DataFrame, size: str = "10 seconds", time_col: str = "record_time",
                      delay: str = "0 seconds") -> DataFrame:
    """Average temperature, humidity and pressure per device and window of `time_col`."""
    per_window = (
        df.withWatermark(time_col, delay)
        .groupBy("device_id", F.window(time_col, size).alias("w"))
        .agg(F.avg("temperature").alias("avg_temp"), F.avg("humidity").alias("avg_humidity"),
             F.avg("pressure").alias("avg_pressure"), F.count("*").alias("count"))
    )
    return per_window.select(
        "device_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        *READING)


def latest_per_window(df: DataFrame) -> DataFrame:
    """The last refinement of each window out of a change log; counts only ever grow."""
    last = F.max_by(F.struct(*READING), "count")
    return (
        df.groupBy("device_id", "window_start", "window_end").agg(last.alias("r"))
        .select("device_id", "window_start", "window_end", "r.*")
    )


def sensor_messages(df: DataFrame) -> DataFrame:
    """(key, value) topic records: windowed key, JSON value with ISO times without zone."""
    start, end = iso_seconds(F.col("window_start")), iso_seconds(F.col("window_end"))
    return df.select(
        F.concat_ws("@", "device_id", start).alias("key"),
        to_json_text(["device_id", start.alias("window_start"), end.alias("window_end"), *READING])
        .alias("value"))
