"""The registered queries of these operators: thin digests of the operators' own results."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import ship
from eventloom.llm.exact_dedup import exact_dedup
from eventloom.llm.hard_negatives import hard_negatives
from eventloom.llm.html_extract import extract_main_text
from eventloom.llm.language_id import fit, learnable, predict
from eventloom.llm.line_dedup import line_dedup
from eventloom.llm.mixing import mix_sources
from eventloom.llm.packing import concatenate, pieces
from eventloom.llm.piece_sampling import encode
from eventloom.llm.simhash import near_duplicates
from eventloom.llm.substring_dedup import substring_dedup
from eventloom.llm.token_alignment import align
from eventloom.llm.topk_search import top_k
from eventloom.llm.warc import read_records, write_archives

Query = Callable[[SparkSession, str], DataFrame]

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
BYTE_TOKENIZER = f"{TOKENIZERS}/byte_bpe_50k.json"
WORD_TOKENIZER = f"{TOKENIZERS}/word_bpe_49k.json"
SAMPLES = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha256(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped", _sha256("kept").alias("kept_sha256"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", _sha256("kept").alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select(
        "row.doc_id", (~learnable(F.col("row.doc_id")) & F.col("row.doc_id").isNotNull()).alias("held_out"),
        "lang_pred", "score")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(_table(spark, sf_dir, "pages"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_table(spark, sf_dir, "documents"), PIECE_MODEL, SAMPLES, decoded=True).select(
        F.col("id").alias("doc_id"), "sample", F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("pieces_hash"), "log_prob", "perturbed", "log_inclusion",
        _sha256("decoded").alias("decoded_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL)
    return found.documents.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = concatenate(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return pieces(stream, with_ids=False).withColumnRenamed("id", "doc_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(_table(spark, sf_dir, "embeddings"))


LLM_QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_topk_search, op2_line_dedup, op3_substring_dedup, op4_language_id, op5_exact_dedup, op6_warc,
        op7_simhash, op8_mixing, op9_sentencepiece, op10_html_extraction,
        op11_token_alignment, op12_packing, op13_hard_negatives)
}
