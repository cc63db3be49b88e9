"""Language of a document by a bidirectional gated recurrent network over its bytes.

Learning takes a bounded sample of labelled rows; labelling runs over every byte of every text. Texts
are cut into segments of `length` bytes, thousands of segments go through the network together, every
position gets a distribution over the languages, and a document's is the mean over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from eventloom.llm import gru
from eventloom.llm.common import slices, uniform, utf8

UNKNOWN = "und"
_BLOCK = 1024


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: dict[str, np.ndarray] | None
    length: int


def learnable(id_col: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 4, is not 2; never a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _segments(bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of segments that cover every text."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // length)
    text = np.repeat(np.arange(len(sizes)), pieces)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = bounds[:-1][text] + inner * length
    return begin, np.minimum(begin + length, bounds[1:][text]), text


def _bytes_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """(length, segments), PAD past the end of a segment."""
    at = begin + np.arange(length)[:, None]
    return np.where(at < end, data[np.minimum(at, len(data) - 1)].astype(np.int64), gru.PAD)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = 800, pieces: int = 4, length: int = 128, width: int = 8, steps: int = 300,
        seed: int = 11) -> LanguageModel:
    """Learn from at most `per_language` rows (in the mean) of each language, `pieces` segments of each.

    Rows are drawn by a hash of their id, so the sample is the same in every run. What reaches the
    driver is per_language x pieces x length bytes a language. Null languages, null texts and texts
    without a letter are not learned from; without any labelled row, every prediction is `und`.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        learnable(F.col("id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    labels = tuple(sorted(counts))
    if not labels:
        return LanguageModel((), None, length)
    share = F.create_map(*(F.lit(x) for n in labels for x in (n, min(1.0, per_language / counts[n]))))
    data = F.col("text").cast("binary")
    room = F.greatest(F.octet_length("text") - length, F.lit(0)) + 1
    cuts = F.array(*(F.substring(data, (F.floor(uniform(F.lit(seed + 1 + i), F.col("id")) * room) + 1).cast("int"),
                                 F.lit(length)) for i in range(pieces)))
    rows = (
        labelled.where(uniform(F.lit(seed), F.col("id")) < share[F.col("lang")])
        .select("lang", cuts.alias("cuts")).toArrow()
    )
    # The order in which rows arrive must not matter.
    found = sorted({(lang, cut) for lang, some in zip(rows["lang"].to_pylist(), rows["cuts"].to_pylist()) for cut in some})
    segments = np.full((len(found), length), gru.PAD, np.int64)
    for row, (_, cut) in zip(segments, found):
        row[:len(cut)] = np.frombuffer(cut, np.uint8)
    # Every other segment is cut short, so that short texts are learned too.
    short = np.random.default_rng(seed).integers(4, length + 1, len(segments))
    short[::2] = length
    segments[np.arange(length) >= short[:, None]] = gru.PAD
    names = np.array([labels.index(lang) for lang, _ in found])
    # Languages count alike, however many rows each has.
    by_label = [np.flatnonzero(names == i) for i in range(len(labels))]
    most = max(map(len, by_label))
    even = np.concatenate([np.resize(x, most) for x in by_label])
    return LanguageModel(labels, gru.train(segments[even], names[even], len(labels), width, steps, seed=seed), length)


def pooled(model: LanguageModel, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, labels): mean over all positions of the chances at each position."""
    n = len(bounds) - 1
    sums = np.zeros((len(model.labels), n))
    begin, end, text = _segments(bounds, model.length)
    # Segments of one length run together, so that hardly any step is spent past an end.
    order = np.argsort(end - begin, kind="stable")
    for at in range(0, len(order), _BLOCK):
        part = order[at:at + _BLOCK]
        longest = int((end[part] - begin[part]).max())
        codes = _bytes_of(data, begin[part], end[part], longest)
        chances = gru.label_positions(model.weights, codes)
        if int((end[part] - begin[part]).min()) < longest:
            chances *= (codes != gru.PAD)[:, None, :]
        totals = chances.sum(axis=0)
        for label in range(len(sums)):
            sums[label] += np.bincount(text[part], totals[label], n)
    return (sums / np.maximum(np.diff(bounds), 1)).T


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", row: str = "row") -> DataFrame:
    """`row`, a struct of all columns of the table, with `lang_pred` and `score` beside it.

    A text that is null or has no letter is `und` with score 0. No column but the text is looked at,
    so rows that repeat get the same answer. Of languages with the same chance the first by name is
    taken. Long texts are read in segments, whole.
    """
    given = docs.select(F.struct("*").alias("row"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    place = docs.columns.index(text_col)
    # A typed schema, not text: column names of the table may hold any character.
    schema = (
        StructType().add("row", given.schema["row"].dataType)
        .add("lang_pred", StringType()).add("score", DoubleType())
    )

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(0).field(place)        # the text goes to the worker once, in its row
            for batch in slices([pa.RecordBatch.from_arrays([*whole.columns, texts], ["row", "letters", "text"])], "text", 1 << 20):
                blank = ~np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool) | (model.weights is None)
                chances = np.zeros((batch.num_rows, 1)) if model.weights is None else pooled(model, *utf8(batch.column(2)))
                best = chances.argmax(axis=1)
                langs = [UNKNOWN if b else model.labels[i] for b, i in zip(blank.tolist(), best.tolist())]
                score = np.where(blank, 0.0, np.clip(chances.max(axis=1), 0.0, 1.0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    return given.mapInArrow(label, schema).withColumnRenamed("row", row)
