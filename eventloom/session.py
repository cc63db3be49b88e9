"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "eventloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC session with adaptive execution and RocksDB streaming state.

    `spark.sql.shuffle.partitions` is deliberately not fixed: size it to the cluster (adaptive
    execution coalesces downwards in batch; a streaming checkpoint freezes it).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.variant.allowDuplicateKeys", "true")  # the gate takes any readable JSON
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
