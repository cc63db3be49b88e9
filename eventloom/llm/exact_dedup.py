"""Exact duplicates by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts, an external sort puts equal texts next to
each other, and neighbours are compared in full. Rows are sorted by a short beginning of the text, a
hash of it, and the text itself: the splitters that Spark samples hold the first two only, so they
stay small however long the texts are, and texts that begin alike still spread. A salt taken from
the id is part of the first sort, so a group of copies of any size is cut into runs that lie in many
partitions; the runs, at most `salts` for a text, are then sorted and compared in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import ascii_lower

_BEGINNING = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = 256, parts: int | None = None) -> DataFrame:
    """`id`, `keep_id`, `group_size`, `kept`, `text_sha256` for every row.

    Null counts as the empty text, and texts are equal when they are after lower-casing A-Z. The
    row with the largest id stays (a null id is below all others); of rows that repeat that id and
    text, one stays. Other columns of the table are not read.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = (
        docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
        .withColumns({
            "begin": F.substring("norm", 1, _BEGINNING), "hash": F.xxhash64("norm"),
            "salt": F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"),
        })
    )
    text = ("begin", "hash", "norm")
    run = Window.partitionBy(*text, "salt")
    runs = (
        rows.repartitionByRange(parts, "begin", "hash", "salt")
        .withColumns({
            "nth": F.row_number().over(run.orderBy(F.col("id").desc_nulls_last())),
            "n": F.count("*").over(run),
        })
        .withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    )
    group = Window.partitionBy(*text)
    best = F.row_number().over(group.orderBy(F.col("id").desc_nulls_last(), "salt"))
    verdicts = (
        runs.where(F.col("nth") == 1)
        .repartitionByRange(parts, "begin", "hash")
        .select("text_sha256", "salt", F.max("id").over(group).alias("keep_id"),
                F.sum("n").over(group).alias("group_size"), (best == 1).alias("best"))
    )
    return (
        runs.select("id", "text_sha256", "salt", "nth")
        # Every row has its run. An outer join keeps both branches alike, so that one shuffle of the
        # texts serves both.
        .join(verdicts, ["text_sha256", "salt"], "left")
        .select("id", "keep_id", "group_size", (F.col("best") & (F.col("nth") == 1)).alias("kept"),
                "text_sha256")
    )
