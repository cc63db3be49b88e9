"""Lines that many documents share, dropped everywhere but in one document.

Lines are exploded, normalised and hashed (128 bits); documents are counted per hash; the lines
over the threshold go and the rest is put together by position. Only hashes are shuffled to be
counted, and a hash is counted in two steps, so that one very common line stays spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, ascii_lower, stored


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _fingerprint(key: Column) -> list[Column]:
    """Two hashes of one text that are independent: the second starts from another state."""
    return [F.xxhash64(key), F.xxhash64(F.lit("line"), key)]


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.lit("row"), text)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_docs: int = 5, min_length: int = 40) -> DataFrame:
    """`id`, `n_lines`, `n_dropped`, `kept` (text) for every row.

    A null or empty text is one empty line. Rows that share an id are one document when documents
    are counted; a null id is a document too, smaller than all others. Of a line found in
    `min_docs` documents or more, every copy in the largest id stays, and all others go. Other
    columns of the table are not read, so their names do not matter.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)

    # Of each row only the long lines travel, as (row, position, hash).
    long_lines = (
        rows.select("id", _row_key(F.col("text")).alias("row"), F.posexplode(lines).alias("pos", "line"))
        .where(F.length("line") >= min_length)
        .select("id", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_length)
        .select("id", "row", "pos", *(h.alias(n) for h, n in zip(_fingerprint(F.col("key")), ("h1", "h2"))))
    )
    # One row per common line; written, so that its size is known before it is joined.
    common = stored(
        long_lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper"),
        "lines",
    )
    dropped = (
        long_lines.join(common, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "row").agg(F.collect_set("pos").alias("dropped"))
        .withColumnsRenamed({"id": "dropped_id", "row": "dropped_row"})
    )
    joined = rows.join(dropped, F.col("id").eqNullSafe(F.col("dropped_id"))
                       & (_row_key(F.col("text")) == F.col("dropped_row")), "left")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped")),
        lambda i: F.get(lines, i))
    return joined.select(
        "id", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(kept, "\n")).alias("kept"),
    )
