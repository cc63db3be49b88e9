"""From documents to sampled token sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.llm.catalog import PIECE_MODEL, SAMPLES
from eventloom.llm.common import ascii_lower, ship, stored
from eventloom.llm.exact_dedup import exact_dedup
from eventloom.llm.language_id import UNKNOWN, fit, predict
from eventloom.llm.mixing import mixed_documents
from eventloom.llm.near_copies import near_copies, text_key
from eventloom.llm.piece_sampling import encode

#: A document goes where no language is clear: no letters, or a mean chance below this.
LEAST_SCORE = 0.35


def _with_row(docs: DataFrame, **keys) -> DataFrame:
    """All columns of a row as one struct, beside keys whose names cannot clash with them."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in keys.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay, all their rows alike. Null and empty texts, texts without a
    letter, and those whose best mean chance is below LEAST_SCORE go; long texts are read whole."""
    ship(spark)
    found = predict(docs, fit(docs))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays; of rows that repeat its id, one. Null and empty
    texts are equal; a null id stays only where its text has no other. Whole texts are compared."""
    key = lambda text, own: F.concat_ws("/", text, F.coalesce(own.cast("string"), F.lit("-")))
    # Written first: a condition on the verdicts must not change the plan that finds them.
    verdicts = stored(exact_dedup(docs).select("id", "text_sha256", "kept"), "verdicts")
    kept = verdicts.where("kept").select(key(F.col("text_sha256"), F.col("id")).alias("kept_key"))
    text = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    rows = _with_row(docs, own=key(text, F.col("doc_id")))
    one = Window.partitionBy("own").orderBy("own")
    return (
        rows.join(kept, F.col("own") == F.col("kept_key"), "left_semi")
        .withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")
    )


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 or more over five words the one with the smallest id stays.

    Texts without words are alike, null and empty ones too; a null id stays only where its group has no
    other. Of rows that repeat an id and text all stay or none. Whole texts are compared.
    """
    ship(spark)
    kept = near_copies(docs).where(F.col("id").eqNullSafe(F.col("component_id"))).select("id", "key")
    return _with_row(docs, own_id=F.col("doc_id"), own_key=text_key(F.col("text"))).join(
        kept, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")), "left_semi").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice; those without words go.

    Null ids and sources are values of their own. Of rows that repeat an id, source and size as many
    are taken as their share of the target asks for.
    """
    return mixed_documents(docs).select("row.*")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row: doc_id, copy, sample, ids and their scores.

    Rows that repeat an id and text are copies, counted from 1, and each has samples of its own. Null and
    empty texts have one segmentation, without pieces; null ids are a value like others.
    """
    ship(spark)
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    rows = docs.select(F.struct("doc_id", nth.alias("copy")).alias("own"), "text")
    found = encode(rows, PIECE_MODEL, SAMPLES, id_col="own")
    return found.select("id.doc_id", "id.copy", "sample", "ids", "log_prob", "perturbed", "log_inclusion")


STAGES = [
    ("language_id", language), ("exact_dedup", exact), ("simhash_dedup", near), ("mixing", mix),
    ("sentencepiece", pieces),
]

#: The network, the fingerprints and the samples cannot be said in SQL; tests/llm has brute force for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
