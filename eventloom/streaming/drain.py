"""Closing the last windows of a source that has been read up.

A window is emitted when the watermark passes its end, so the windows that are open when a bounded
source ends would never come out. A marker row behind every possible event moves the watermark over
all of them. The marker's own windows end behind the marker, so the watermark, which lies before it,
never closes those; they stay in the state and in no result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from eventloom.sources.files import parquet_stream

#: Event time of markers in epoch ms: the first moment of the year 9999.
END_MS = 253_370_764_800_000


def _folder(root: str) -> str:
    return f"{root}/_markers"


def with_markers(events: DataFrame, root: str) -> DataFrame:
    """A stream of events that also takes the markers put under `root`; watermarks go on the result.

    The markers are a source of their own, so a checkpoint that was begun without them does not fit.
    """
    folder = _folder(root)
    events.sparkSession.createDataFrame([], events.schema).write.mode("append").parquet(folder)
    return events.unionByName(parquet_stream(events.sparkSession, folder, events.schema))


def put_marker(spark: SparkSession, root: str, schema: T.StructType, time_col: str = "timestamp") -> None:
    """One row that is null but for its time. Rows of events that come after it are late."""
    marker = [F.lit(END_MS if f.name == time_col else None).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*marker).write.mode("append").parquet(_folder(root))


def run_and_drain(start: Callable[[], StreamingQuery], put: Callable[[], None]) -> StreamingQuery:
    """Read the source up, then put the marker and run on from the checkpoint until all is emitted.

    The marker comes last, whatever number of micro-batches the source takes. `start` starts the same
    query, which stops by itself, each time.
    """
    start().awaitTermination()
    put()
    query = start()
    query.awaitTermination()
    return query
