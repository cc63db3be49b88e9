"""Packing of token streams into windows: concatenate and cut.

The first pass tokenises every document and sums the tokens before it within its partition. Sums over
partitions, in two steps, say where each partition begins in the one stream of all documents. The
second pass cuts the stream at fixed places: every window holds `window` tokens, and what is left at
the end of the stream is cut into powers of two, so that nothing is padded.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import slices, stored, utf8

#: Words that a worker keeps with their ids, and ids it keeps; beyond, it begins anew.
_MOST_WORDS, _MOST_IDS = 400_000, 4_000_000
#: New words that are encoded at once.
_TOGETHER = 16_384
#: Characters of a text that are cut into words at once.
_PIECE = 1 << 20
#: Partitions whose totals are summed up together.
_BUNDLE = 1024


#: White space is all alike to the tokenizer, and a run of letters ends before a mark: such marks are
#: words of their own here, so that fewer different words are met.
_MARK = r"([A-Za-z])([.,;:!?])"


def _lower(text: pa.Array) -> pa.Array:
    """ASCII letters lower-cased where this cannot change ids: not beside special tokens, or before
    accents that only a small letter melts with."""
    kept = pc.match_substring_regex(text, f"<\\||[{''.join(_SMALL_ONLY)}]")
    small = [t if k else t.encode().lower().decode() for t, k in zip(text.to_pylist(), kept.to_pylist())]
    return pa.array(small, pa.large_string())


_SMALL_ONLY = [m for m in map(chr, range(0x300, 0x370)) if any(
    len(unicodedata.normalize("NFC", c.lower() + m)) < len(unicodedata.normalize("NFC", c + m)) for c in string.ascii_uppercase)]


def _letters(word: str) -> bool:
    """Whether the tokenizer sees one run of letters in a word."""
    return word.isalpha() and (word.isascii() or ("İ" not in word and unicodedata.is_normalized("NFC", word)))


class WordIds:
    """Ids of texts, word by word: no token reaches over a space, so that words are encoded on their own."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = bool(suffix) and token.endswith(suffix)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.bounds = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.place)
        self.place.update(zip(words, range(first, first + len(words))))
        self.ids = np.concatenate((self.ids, ids))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))

    def _learn(self, words: list[str]) -> None:
        """Some at a time: what the tokenizer returns takes a hundred bytes a token."""
        for at in range(0, len(words), _TOGETHER):
            self._learn_some(words[at:at + _TOGETHER])

    def _learn_some(self, new: list[str]) -> None:
        """Runs of letters are encoded one behind the other and told apart by their closing tokens."""
        runs = [w for w in new if _letters(w)]
        texts = [" ".join(runs[i:i + 128]) for i in range(0, len(runs), 128)]
        ids = np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], np.int32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(runs):
            self._add(runs, ids, np.diff(ends, prepend=0))
        others = new if len(ends) != len(runs) else [w for w in new if not _letters(w)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        self._add(others, np.array([i for own in found for i in own], np.int32), np.array([len(own) for own in found], np.int64))

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of different words begin, and how many each has."""
        if len(self.place) > _MOST_WORDS or len(self.ids) > _MOST_IDS:
            self._clear()
        new = [w for w in words if w not in self.place]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        return self.bounds[at], self.bounds[at + 1] - self.bounds[at]

    def _of_some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.replace_substring(_lower(texts), "\n", " ")
        words = pc.split_pattern(pc.replace_substring_regex(plain, _MARK, r"\1 \2"), " ")
        known = words.flatten().dictionary_encode()
        start, size = self._encoded(known.dictionary.to_pylist())
        which = known.indices.to_numpy()
        sizes = size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.arange(total) + np.repeat(start[which] - (ends - sizes), sizes)]
        before = np.concatenate(([0], ends))[words.offsets.to_numpy()]
        return ids, np.diff(before)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one run, and how many each text has."""
        _, bounds = utf8(texts)
        if len(texts) != 1 or bounds[-1] <= 2 * _PIECE:
            return self._of_some(texts)
        text, at, found = texts[0].as_py(), 0, []
        while at < len(text):        # a long text is cut at spaces
            cut = text.find(" ", at + _PIECE)
            upto = cut if cut >= 0 else len(text)
            found.append(self._of_some(pa.array([text[at:upto]], pa.large_string()))[0])
            at = upto
        return np.concatenate(found), np.array([sum(map(len, found))])


def _tokenised(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = WordIds(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", 2 << 20):
            ids, sizes = words.of(batch.column(1).cast(pa.large_string()).fill_null(""))
            bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
            closed = np.full(bounds[-1], end_id, np.int32)
            inner = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)
            closed[inner] = ids
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(before + bounds[:-1]),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(closed))],
                ["id", "part", "before", "ids"])
            before += int(bounds[-1])

    return run


@dataclass(frozen=True)
class Stream:
    """All documents in a row: `tokens` has `id`, `at` (place of its first token), `ids`."""

    tokens: DataFrame
    total: int


def concatenate(docs: DataFrame, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id",
                text_col: str = "text") -> Stream:
    """Every document's ids, then `end_id`; null texts are empty. The order is that of the partitions.

    The tokenizer must take all white space alike and let no token reach over it. Rows that repeat are
    documents of their own. Long texts are cut at spaces while they are tokenised, and stay one row.
    """
    with open(tokenizer_file, encoding="utf-8") as file:        # the driver's file goes with the tasks
        tokenizer = file.read()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    tokens = stored(given.mapInArrow(_tokenised(tokenizer, end_id), f"id {kind}, part int, before long, ids array<int>"),
                    "tokens")
    totals = stored(
        tokens.groupBy("part").agg(F.max(F.col("before") + F.size("ids")).alias("n"))
        .withColumn("bundle", F.floor(F.col("part") / _BUNDLE)), "totals")
    ahead = lambda *key: Window.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda n, over: F.coalesce(F.sum(n).over(over), F.lit(0).cast("long"))
    bundles = totals.groupBy("bundle").agg(F.sum("n").alias("n")).select(
        "bundle", summed("n", ahead("bundle")).alias("base"))
    bases = stored(
        totals.withColumn("inner", summed("n", ahead("bundle", "part"))).join(bundles, "bundle")
        .select("part", (F.col("base") + F.col("inner")).alias("base")), "bases")
    total = totals.agg(F.sum("n")).first()[0] or 0
    return Stream(tokens.join(bases, "part").select("id", (F.col("base") + F.col("before")).alias("at"), "ids"), total)


class Cuts:
    """Where a stream of `total` tokens is cut."""

    def __init__(self, total: int, window: int):
        self.window, self.whole = window, total // window
        left = total % window
        powers = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        self.tail = np.concatenate(([0], np.cumsum(powers, dtype=np.int64))).astype(np.int64)

    def number(self, at: np.ndarray) -> np.ndarray:
        """The window that a place is in."""
        behind = at - self.whole * self.window
        return np.where(behind < 0, at // self.window,
                        self.whole + np.searchsorted(self.tail, behind, side="right") - 1)

    def start(self, number: np.ndarray) -> np.ndarray:
        """Where a window begins; that of the window after the last is the end of the stream."""
        return np.minimum(number, self.whole) * self.window + self.tail[
            np.clip(number - self.whole, 0, len(self.tail) - 1)]


def _pieces_of(cuts: Cuts, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, from, upto, window) of the pieces of runs of n tokens; every run has one token at least."""
    first, last = cuts.number(at), cuts.number(at + n - 1)
    count = last - first + 1
    row = np.repeat(np.arange(len(at)), count)
    window = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
    return row, np.maximum(cuts.start(window), at[row]), np.minimum(cuts.start(window + 1), (at + n)[row]), window


def pieces(stream: Stream, window: int = 2048, with_ids: bool = True) -> DataFrame:
    """`id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`, and `ids` if wanted.

    One row per document and window that it reaches into. `start` is the place in the document and
    `offset` that in the window; each token lies in one piece, and the pieces of a window leave no gap.
    """
    cuts = Cuts(stream.total, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, column = batch.column(1).to_numpy(), batch.column(2)
            bounds, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
            row, lo, hi, number = _pieces_of(cuts, at, np.diff(bounds))
            shift = (bounds[:-1] - at)[row]
            data = flat.astype("<u4").view(np.uint8)
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip((lo + shift).tolist(), (hi + shift).tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(lo - at[row]), pa.array(hi - lo),
                       pa.array(crc, pa.int64()), pa.array(np.diff(bounds)[row]), pa.array(number),
                       pa.array(lo - cuts.start(number))]
            if with_ids:        # pieces follow each other without a gap, and so do their ids
                edges = np.concatenate(([0], np.cumsum(hi - lo))).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat[bounds[0]:bounds[-1]])))
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = stream.tokens.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    ddl += ", ids array<int>" * with_ids
    names = [part.split()[0] for part in ddl.split(", ")]
    return stream.tokens.mapInArrow(cut, ddl)


def sequences(stream: Stream, window: int = 2048) -> DataFrame:
    """`sequence_id`, `ids`: the windows themselves, each with all its tokens.

    A window that lies in one task's run of tokens is put together there; only what a task holds of
    the windows at the ends of its runs goes through a shuffle, as boundary records.
    """
    cuts = Cuts(stream.total, window)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, held, size = 0, [], 0           # one run of tokens that follow each other

        def cut(upto_end: bool) -> pa.RecordBatch:
            nonlocal begin, held, size
            flat = np.concatenate(held)
            _, lo, hi, number = _pieces_of(cuts, np.array([begin]), np.array([size]))
            if not upto_end and hi[-1] < cuts.start(number[-1] + 1):       # the last window may go on
                lo, hi, number = lo[:-1], hi[:-1], number[:-1]
            end = int(hi[-1]) - begin if len(hi) else 0
            edges = np.append(lo - begin, end).astype(np.int32)
            whole = (lo == cuts.start(number)) & (hi == cuts.start(number + 1))
            out = pa.RecordBatch.from_arrays([
                pa.array(number), pa.array(lo - cuts.start(number)), pa.array(whole),
                pa.ListArray.from_arrays(pa.array(edges), pa.array(flat[:end]))], ["sequence_id", "offset", "whole", "ids"])
            begin, held, size = begin + end, [flat[end:]], size - end
            return out

        for batch in batches:
            column = batch.column(2)
            bounds, flat = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
            for at, a, b in zip(batch.column(1).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                if size and at != begin + size:
                    yield cut(True)
                if not size:
                    begin, held = at, []
                held.append(flat[a:b].copy())
                size += b - a
                if size > 1 << 18:
                    yield cut(False)
        if size:
            yield cut(True)

    parts = stored(stream.tokens.mapInArrow(gather, "sequence_id long, offset long, whole boolean, ids array<int>"), "windows")
    joined = (
        parts.where("not whole").groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))      # `window` records at most
        .select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    )
    return parts.where("whole").select("sequence_id", "ids").unionByName(joined)
