"""What the operators share: written intermediate tables, text expressions, Arrow text as bytes."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import eventloom
from eventloom.config import shared_dir

# The white space that separates words and surrounds lines.
SPACES = "\t\n\x0b\x0c\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, where it is not installed on them."""
    context = spark.sparkContext
    if getattr(context, "_eventloom_sent", False):
        return
    root = Path(eventloom.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="eventloom-")) / "eventloom.zip"     # read by the driver alone
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("eventloom") / file.relative_to(root))
    context.addPyFile(str(archive))
    context._eventloom_sent = True


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: ends the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def parts_for(amount: int, per_part: int) -> int:
    return max(1, math.ceil(amount / per_part))


def uniform(*key: Column) -> Column:
    """A repeatable number in (0, 1) for a key."""
    bits = F.shiftrightunsigned(F.xxhash64(*key), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one run of bytes, and where each begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, starts, data = column.buffers()
    bounds = np.frombuffer(starts, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batches, weight: str, most: int):
    """Record batches cut so that the texts in one column weigh about `most` bytes together."""
    for batch in batches:
        _, bounds = utf8(batch.column(batch.schema.get_field_index(weight)))
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
            upto = min(max(upto, at + 1), batch.num_rows)
            yield batch.slice(at, upto - at)
            at = upto
