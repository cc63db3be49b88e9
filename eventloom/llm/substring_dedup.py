"""Word passages that repeat anywhere in the corpus, removed wherever they are.

A difference cover D modulo v has, for any two positions, a shift below v that moves both into D. So
if two windows of `window` words are equal, they hold equal words at an aligned position of each, and
it is enough to hash `window - v + 1` words from the cover positions on: the anchors. Anchors that
repeat are extended to the windows that hold them, and windows that repeat are removed.

The texts are shuffled once, into groups of documents, and all three passes work on the groups.
Between the passes only hashes travel, packed by hash range; a group sends a hash once however often
it has it, so a passage that all documents share costs one entry a group. Hashes are counted in two
steps: groups form bundles, a bundle counts a hash over its groups in a wide range, and the bundles'
counts meet in narrow ranges. The number of bundles grows with the root of the corpus, so no task
holds an entry of every group, whatever the passage. The answer goes back the same way, one bit for
each hash in the order in which it was sent; who asked forms the same ordered list again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import parts_for, utf8

# A perfect difference set for the modulus.
COVER, PERIOD = (3, 6, 7, 12, 14), 21

_U = np.uint64
_FACTORS = (_U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result hangs on every bit of x."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_CODE = _mix(np.arange(1, 257, dtype=_U) * _FACTORS[0])
_BYTE_CODE[_IS_SPACE] = 0


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, _U)
    if n:
        out[0] = 1
    return np.cumprod(out)


class _Words:
    """The words of some texts: where they are, their hashes, and the texts they belong to."""

    def __init__(self, column: pa.ChunkedArray):
        self.data, bounds = utf8(column)
        # One white space byte after each text, so that words never run on into the next text.
        n, size = len(bounds) - 1, len(self.data)
        lengths = np.diff(bounds)
        self.bounds = bounds + np.arange(n + 1)
        spread = np.full(size + n, 32, np.uint8)
        spread[np.arange(size) + np.repeat(np.arange(n), lengths)] = self.data
        self.data = spread
        inside = ~_IS_SPACE[self.data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)
        self.doc_end = np.repeat(self.first[1:], self.counts)
        self.doc_start = np.repeat(self.first[:-1], self.counts)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        spans = np.diff(np.append(self.starts, len(self.data)))
        inner = np.arange(self.starts[0], len(self.data)) - np.repeat(self.starts, spans)
        table = _powers(_FACTORS[1], int(spans.max()))
        terms = _BYTE_CODE[self.data[self.starts[0]:]] * table[inner]
        sums = np.add.reduceat(terms, self.starts - self.starts[0])
        return _mix(sums + (self.ends - self.starts).astype(_U))

    def windows(self, at: np.ndarray, length: int, kind: int) -> np.ndarray:
        """Hash of `length` words from each of the word positions `at` on."""
        factor = _FACTORS[kind]
        codes = self.hashes if kind == 0 else _mix(self.hashes ^ _U(0xA5A5A5A5A5A5A5A5))
        n = len(codes)
        sums = np.zeros(n + 1, _U)
        np.cumsum(codes * _powers(factor, n), out=sums[1:])
        back = _powers(pow(int(factor), -1, 1 << 64), n)
        return _mix((sums[at + length] - sums[at]) * back[at])

    def anchors(self, length: int) -> np.ndarray:
        at = np.arange(len(self.hashes))
        fits = at + length <= self.doc_end
        return at[fits & np.isin((at - self.doc_start) % PERIOD, COVER)]


def _distinct(h1: np.ndarray, h2: np.ndarray, twice: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Every hash once, in order, its lowest bit set where it comes twice or is marked so already; and
    the place in that list of each hash given."""
    h1 = h1 & ~_U(1)
    order = np.lexsort((h2, h1))
    s1, s2 = h1[order], h2[order]
    new = np.ones(len(s1), bool)
    new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
    firsts = np.flatnonzero(new)
    many = np.diff(np.append(firsts, len(s1))) > 1
    if twice is not None and len(firsts):
        many |= np.logical_or.reduceat(twice[order], firsts)
    place = np.empty(len(s1), np.int64)
    place[order] = np.cumsum(new) - 1
    return s1[firsts] | many.astype(_U), s2[firsts], place


def _packed(h1: np.ndarray, h2: np.ndarray, ranges: int, **same: int) -> pa.Table:
    """Ordered hashes as one row per hash range (`part`), with some values that all rows have."""
    part = ((h1 >> _U(32)) * _U(ranges)) >> _U(32)
    full, starts = np.unique(part, return_index=True)
    cuts = np.append(starts, len(h1)).tolist()
    pack = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.table({
        "part": pa.array(full.astype(np.int64)),
        **{name: pa.array(np.full(len(full), value, np.int64)) for name, value in same.items()},
        "h1": pack(h1), "h2": pack(h2),
    })


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All hashes of some rows as a distinct list, the place of each in it, and where the rows begin."""
    first, second = table["h1"].to_pylist(), table["h2"].to_pylist()
    h1, h2 = np.frombuffer(b"".join(first), _U), np.frombuffer(b"".join(second), np.uint32)
    return *_distinct(h1, h2, (h1 & _U(1)).astype(bool)), np.cumsum([0] + [len(x) // 8 for x in first])


def _answers(table: pa.Table, columns: tuple[str, ...], bits: np.ndarray, bounds: np.ndarray) -> pa.Table:
    """For every row of the table one bit per hash, beside some of its columns."""
    return pa.table({
        **{c: table[c] for c in columns}, "n": pa.array(np.diff(bounds), pa.int64()),
        "bits": pa.array([np.packbits(bits[i:j]).tobytes() for i, j in zip(bounds[:-1], bounds[1:])], pa.binary()),
    })


def _bits(marks: pa.Table, n: int) -> np.ndarray:
    """The answers to an ordered list of n hashes, from its rows in any order."""
    rows = sorted(zip(*(marks[c].to_pylist() for c in ("part", "n", "bits"))))
    found = [np.unpackbits(np.frombuffer(bits, np.uint8), count=count) for _, count, bits in rows]
    bits = np.concatenate(found or [np.zeros(0, np.uint8)]).astype(bool)
    if len(bits) != n:
        raise ValueError(f"{len(bits)} answers to {n} hashes")
    return bits


def _bundled(table: pa.Table, ranges: int) -> pa.Table:
    """Of one wide range and bundle: every hash once, by narrow ranges."""
    h1, h2, _, _ = _unpacked(table)
    return _packed(h1, h2, ranges, wide=table["part"][0].as_py(), bundle=table["bundle"][0].as_py())


def _repeated(table: pa.Table) -> pa.Table:
    """Of one narrow range: to every bundle, which of its hashes have more than one place."""
    h1, _, place, bounds = _unpacked(table)
    return _answers(table, ("wide", "bundle", "part"), (h1 & _U(1)).astype(bool)[place], bounds)


def _handed(sent: pa.Table, marks: pa.Table) -> pa.Table:
    """Of one wide range and bundle: to every group, which of its hashes have more than one place."""
    h1, _, place, bounds = _unpacked(sent)
    return _answers(sent, ("grp", "part", "note"), _bits(marks, len(h1))[place], bounds)


def _covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions below n that lie in one of the spans [begin, end)."""
    steps = np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _no_more(h: np.ndarray) -> np.ndarray:
    return np.zeros(len(h), np.uint32)


def _kept_texts(words: _Words, gone: np.ndarray) -> pa.Array:
    """Of every text the words that stay, joined by one space."""
    starts, ends = words.starts[~gone], words.ends[~gone]
    n = len(words.data)
    take = _covered(n, starts, ends + 1)      # every word with the byte after it
    data = words.data.copy()
    data[ends] = 32
    before = np.concatenate(([0], np.cumsum(take)))[words.bounds]
    data = data[take].tobytes()
    return pa.array([data[a:max(a, b - 1)] for a, b in zip(before[:-1].tolist(), before[1:].tolist())],
                    pa.binary()).cast(pa.string())


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                    group_bytes: int = 2 << 20) -> DataFrame:
    """`id`, `n_words`, `n_removed`, `kept` (text) for every row.

    A word goes if one of the windows that cover it starts anywhere else too, in the same text or
    another; windows are judged on the input. Null texts have no words. Rows that repeat an id, or
    have none, are rows of their own. Other columns are not read. Windows are compared by 94-bit
    hashes; anchors, which only choose what is compared, by 63 bits.
    """
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    anchor = window - PERIOD + 1
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    groups = parts_for(size, group_bytes)
    narrow = parts_for(size, 6 * group_bytes)
    bundles = math.isqrt(narrow - 1) + 1
    wide = parts_for(narrow, bundles)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(groups)).alias("grp"),
        F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def asked(table: pa.Table, h1: np.ndarray, h2: np.ndarray, note: bytes = b"") -> pa.Table:
        """The hashes of a group; the note comes back with the answer, on one of its rows."""
        group = table["grp"][0].as_py() if table.num_rows else 0
        packed = _packed(h1, h2, wide, bundle=group % bundles, grp=group)
        return packed.append_column("note", pa.array([note, *[b""] * packed.num_rows][:packed.num_rows], pa.binary()))

    def anchors_in(words: _Words) -> tuple[np.ndarray, ...]:
        at = words.anchors(anchor)
        h = words.windows(at, anchor, 0)
        return at, *_distinct(h, _no_more(h))

    def windows_near(words: _Words, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows that hold one of the anchors at some positions."""
        n = len(words.hashes)
        begins = np.maximum(at - (PERIOD - 1), words.doc_start[at])
        near = np.flatnonzero(_covered(n, begins, at + 1) & (np.arange(n) + window <= words.doc_end))
        return near, *_distinct(words.windows(near, window, 0), words.windows(near, window, 1).astype(np.uint32))

    def anchors_of(table: pa.Table) -> pa.Table:
        _, h1, h2, _ = anchors_in(_Words(table["text"]))
        return asked(table, h1, h2)

    def bundled(table: pa.Table) -> pa.Table:
        return _bundled(table, wide * bundles)

    def repeated(table: pa.Table) -> pa.Table:
        return _repeated(table)

    def handed(table: pa.Table, marks: pa.Table) -> pa.Table:
        return _handed(table, marks)

    def windows_of(table: pa.Table, marks: pa.Table) -> pa.Table:
        words = _Words(table["text"])
        at, h1, _, place = anchors_in(words)
        bits = _bits(marks, len(h1))
        _, h1, h2, _ = windows_near(words, at[bits[place]])
        return asked(table, h1, h2, np.packbits(bits).tobytes())

    def kept_of(table: pa.Table, marks: pa.Table) -> pa.Table:
        words = _Words(table["text"])
        gone = np.zeros(len(words.hashes), bool)
        if marks.num_rows:      # none: the group has no window that could repeat
            at, h1, _, place = anchors_in(words)
            note = np.frombuffer(max(marks["note"].to_pylist()), np.uint8)
            bits = np.unpackbits(note, count=len(h1)).astype(bool)
            at, h1, _, place = windows_near(words, at[bits[place]])
            at = at[_bits(marks, len(h1))[place]]
            gone = _covered(len(gone), at, at + window)
        lost = np.concatenate(([0], np.cumsum(gone)))[words.first]
        return pa.table({
            "id": table["id"], "n_words": pa.array(words.counts, pa.int64()),
            "n_removed": pa.array(np.diff(lost), pa.int64()), "kept": _kept_texts(words, gone),
        })

    hashes, answers = "h1 binary, h2 binary", "n long, bits binary"
    by_group = rows.groupBy("grp")

    def marked(packed: DataFrame) -> DataFrame:
        """To every group, which of its hashes some other place has too."""
        by_bundle = packed.groupBy("part", "bundle")
        marks = (
            by_bundle.applyInArrow(bundled, f"part long, wide long, bundle long, {hashes}")
            .groupBy("part").applyInArrow(repeated, f"wide long, bundle long, part long, {answers}")
        )
        return by_bundle.cogroup(marks.groupBy("wide", "bundle")).applyInArrow(
            handed, f"grp long, part long, note binary, {answers}")

    of_group = f"part long, bundle long, grp long, {hashes}, note binary"
    anchor_marks = marked(by_group.applyInArrow(anchors_of, of_group))
    window_marks = marked(by_group.cogroup(anchor_marks.groupBy("grp")).applyInArrow(windows_of, of_group))
    return by_group.cogroup(window_marks.groupBy("grp")).applyInArrow(
        kept_of, f"id {id_type}, n_words long, n_removed long, kept string")
