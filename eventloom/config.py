"""Where topics and shared folders live; every value can come from the environment."""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class JobConfig:
    bootstrap: str = field(default_factory=lambda: os.environ.get("KAFKA_BOOTSTRAP", "kafka:9092"))
    events_topic: str = "raw_events"
    cdc_topic: str = "iot.public.sensor_data"
    sensor_topic: str = "sensor.aggregates"
    event_delay: str = "5 seconds"
    sensor_delay: str = "0 seconds"
    state_partitions: int | None = None
    files_per_day: int | None = None     # None: as many as a run's size asks for
    # Bounds of a micro-batch, so that neither the first one nor one after a pause takes the whole
    # backlog: records of a topic, files of a folder; and the pause between batches, as an interval.
    offsets_per_batch: int | None = field(default_factory=lambda: _number("EVENTLOOM_OFFSETS_PER_BATCH"))
    files_per_batch: int | None = field(default_factory=lambda: _number("EVENTLOOM_FILES_PER_BATCH"))
    batch_interval: str | None = field(default_factory=lambda: os.environ.get("EVENTLOOM_BATCH_INTERVAL") or None)

    def trigger(self, available_now: bool) -> dict[str, object]:
        """Arguments of a writer's trigger: read up and stop, or go on, in the stated interval."""
        if available_now:
            return {"availableNow": True}
        return {"processingTime": self.batch_interval or "0 seconds"}


def _number(variable: str) -> int | None:
    value = os.environ.get(variable)
    return int(value) if value else None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or a local one where none is set.

    The local fallback is for single-machine runs such as tests; a cluster must name the folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        path = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path
