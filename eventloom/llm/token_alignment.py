"""Alignment of two tokenizers over a corpus, counted with inverted bitmaps of token pairs.

Both tokenizers' tokens have byte ranges in the same text; a token of one and a token of the other are
linked where their ranges overlap. For every pair of ids the documents that hold it linked are kept as
compressed bitmaps, one container per block of documents, in planes: plane p has the documents whose
number of links of the pair has bit p set. Containers of the same pair, block and plane are OR-merged;
popcounts of the planes, shifted, give the pair's links, and popcounts of all planes together its
documents. For scores of documents the containers are read as postings: each returns what its pair
counts to the documents whose bits are set.

No token of either begins before a single space or line end between two words and ends behind it, so
texts are cut there, and what both tokenizers make of a piece is worked out once and kept.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import slices, stored

#: Documents of a block, and bytes of its bitmap. A container holds a bitmap, or the documents' places
#: as 16-bit numbers where these are shorter.
BLOCK = 4096
_MAP = BLOCK // 8
#: A worker lets go of what it holds beyond so many pieces of text, links in them, entries of a block.
_MOST_PIECES, _MOST_LINKS, _MOST_ENTRIES = 300_000, 3_000_000, 2_000_000
#: Characters of a text that are looked at together.
_STRETCH = 1 << 20
# Fixed value: the mark that stands for a space.
_SPACE = "▁"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Pieces that are encoded one behind the other, at least.
_TOGETHER = 64


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves,
    the others in order from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(others)}


def joined(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, ends): the tokens that each link joins, and where tokens of both end, from byte ends.

    Tokens that overlap share one stretch between ends of either, and each such stretch is in one of both.
    """
    every = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, every), np.searchsorted(b_ends, every), np.intersect1d(a_ends, b_ends, assume_unique=True)


class _Spelled:
    """Texts by number, as one run of bytes."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        self.sizes = np.diff(self.at)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[_runs(self.at[numbers], self.sizes[numbers])]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every start, size of each."""
    before = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - before, size)


class Pieces:
    """What both tokenizers make of pieces of text; every piece begins with white space.

    Pieces are learned many at a time: those that begin with one space or line end and stop with another
    character are encoded one behind the other, as in a text, and told apart by their bytes.
    """

    def __init__(self, byte_tokenizer: str, piece_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_tokenizer)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        alphabet = _byte_alphabet()
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = _Spelled([bytes(alphabet.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(n_a)])
        self.b_bytes = _Spelled([
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace(_SPACE, " ").encode() for i in range(n_b)])
        self.digits = _Spelled([str(i).encode() for i in range(max(n_a, n_b))])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, 5), np.int64)        # tokens of a, of b, groups, links, 1 where bytes differ
        self.said, self.said_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)        # groups as text, each with a ;
        self.codes, self.at = np.zeros(0, np.int64), np.zeros(1, np.int64)            # a << 32 | b of every link

    @property
    def full(self) -> bool:
        return len(self.place) > _MOST_PIECES or len(self.codes) > _MOST_LINKS

    def _add(self, pieces: list[str], sums, said, said_sizes, codes, code_sizes) -> None:
        first = len(self.place)
        self.place.update(zip(pieces, range(first, first + len(pieces))))
        self.sums = np.concatenate((self.sums, sums))
        self.said = np.concatenate((self.said, said))
        self.said_at = np.concatenate((self.said_at, self.said_at[-1] + np.cumsum(said_sizes)))
        self.codes = np.concatenate((self.codes, codes))
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(code_sizes)))

    def _texts_of(self, groups: np.ndarray, ids: np.ndarray, is_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;` of tokens that lie by group, a before b; and the bytes that each token takes."""
        last = np.ones(len(ids), bool)
        last[:-1] = groups[1:] != groups[:-1]
        turn = np.zeros(len(ids), bool)
        turn[:-1] = is_b[1:] != is_b[:-1]
        sizes = self.digits.sizes[ids] + 1
        ends = np.cumsum(sizes)
        out = np.zeros(int(sizes.sum()), np.uint8)
        out[_runs(ends - sizes, sizes - 1)] = self.digits.of(ids)
        out[ends - 1] = np.where(last, ord(";"), np.where(turn, ord("|"), ord(",")))
        return out, sizes

    def _learn(self, pieces: list[str], texts: list[str], whole: bytes, sizes: np.ndarray) -> bool:
        """Pieces of the stated numbers of bytes, which the texts hold one after the other; False if
        the bytes that tokens stand for are not those of the texts."""
        found = (self.a.encode_batch_fast(texts, add_special_tokens=False),
                 self.b.encode([t[1:] for t in texts], num_threads=1))       # b adds the space
        a = np.array([i for e in found[0] for i in e.ids], np.int64)
        b = np.array([i for ids in found[1] for i in ids], np.int64)
        given = np.frombuffer(whole, np.uint8)
        if not all(np.array_equal(spelled.of(ids), given) for spelled, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return False
        a_ends, b_ends = np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b_bytes.sizes[b])
        link_a, link_b, common = joined(a_ends, b_ends)
        bounds = np.cumsum(sizes)
        piece = lambda ends: np.searchsorted(bounds, ends)
        n = len(sizes)
        count = lambda ends: np.bincount(piece(ends), minlength=n)
        links = count(np.union1d(a_ends, b_ends))
        group = np.concatenate((np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)))
        is_b = np.repeat([False, True], [len(a), len(b)])
        order = np.argsort(group * 2 + is_b, kind="stable")
        said, token_sizes = self._texts_of(group[order], np.concatenate((a, b))[order], is_b[order])
        said_sizes = np.bincount(piece(common)[group[order]], token_sizes, n).astype(np.int64)
        sums = np.stack([count(a_ends), count(b_ends), count(common), links, np.zeros(n, np.int64)], axis=1)
        self._add(pieces, sums, said, said_sizes, a[link_a] << 32 | b[link_b], links)
        return True

    def learn(self, new: list[str]) -> None:
        plain = [p for p in new if p[0] in " \n" and not p[1:2].isspace() and p[1:] and not p[-1].isspace() and _SPACE not in p]
        # Texts begin with a space, for b; so each begins with a piece that does.
        starts = [p for p in plain if p[0] == " "]
        ordered = starts + [p for p in plain if p[0] != " "] if starts else []
        step = max(1, -(-len(ordered) // max(1, len(starts))), _TOGETHER)
        heads, rest = starts[:-(-len(ordered) // step)], []
        if ordered:
            rest = ordered[len(heads):]
            parts, at = [], 0
            for i, head in enumerate(heads):
                upto = (len(rest) * (i + 1)) // len(heads)
                parts.append([head, *rest[at:upto]])
                at = upto
            pieces = [p for part in parts for p in part]
            whole = ["".join(part) for part in parts]
            sizes = np.array([len(p.encode()) for p in pieces], np.int64)
            if not self._learn(pieces, whole, "".join(whole).encode(), sizes):
                ordered = []
        known = set(ordered)
        for p in new:
            if p not in known:
                self._alone(p)

    def _alone(self, piece: str) -> None:
        whole = piece.encode()
        if piece[0] == " ":
            if self._learn([piece], [piece], whole, np.array([len(whole)])):
                return
        elif _SPACE not in piece:
            # Behind a line end or the like: what is encoded before it must not count.
            before = Pieces.__new__(Pieces)
            before.__dict__.update(self.__dict__)
            before.clear()
            if before._learn([" a", piece], [" a" + piece], b" a" + whole, np.array([2, len(whole)])):
                self._add([piece], before.sums[1:], before.said[before.said_at[1]:], np.diff(before.said_at)[1:],
                          before.codes[before.at[1]:], np.diff(before.at)[1:])
                return
        none = np.zeros(0, np.int64)
        self._add([piece], np.array([[0, 0, 0, 0, 1]]), none.astype(np.uint8), [0], none, [0])

    def whole(self, text: str) -> bool:
        """Whether both tokenizers give a long text back."""
        for stretch in cut(text):
            if self.full:
                self.clear()
            at = self.of(stretch)
            if self.sums[at, 4].any():
                return False
        return True

    def of(self, stretch: list[str]) -> np.ndarray:
        """Places of pieces in the tables; unknown ones are learned."""
        new = [p for p in dict.fromkeys(stretch) if p not in self.place]
        if new:
            self.learn(new)
        return np.fromiter(map(self.place.__getitem__, stretch), np.int64, len(stretch))


def cut(text: str) -> Iterator[list[str]]:
    """The pieces of space and text, some at a time: each begins at a single space or line end between
    two other characters, which no token of either tokenizer reaches over."""
    whole, at = " " + text, 0
    while at < len(whole):
        found = None if len(whole) - at <= _STRETCH else _CUT.search(whole, at + _STRETCH)
        upto = found.start() if found else len(whole)
        yield _CUT.split(whole[at:upto])
        at = upto


def _entries(doc: np.ndarray, code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same entries with equal (pair, document) added up, in order of pair and document."""
    order = np.lexsort((doc, code))
    doc, code, times = doc[order], code[order], times[order]
    first = _starts(code, doc)
    return doc[first], code[first], np.add.reduceat(times, first)


def containers(doc: np.ndarray, times: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(group, plane, container) of entries that lie by group and document."""
    groups, planes, out = [], [], []
    for plane in range(int(times.max(initial=0)).bit_length()):
        has = np.flatnonzero(times >> plane & 1)
        own, places = group[has], doc[has].astype("<u2")
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        data = places.tobytes()
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(own)]):
            if 2 * (b - a) < _MAP:
                out.append(data[2 * a:2 * b])
            else:
                out.append(_bitmaps(places[a:b], np.zeros(b - a, np.int64), 1)[0].tobytes())
        groups.append(own[first])
        planes.append(np.full(len(first), plane))
    if not groups:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    return np.concatenate(groups), np.concatenate(planes), out


def _bitmaps(places: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    bits = np.zeros((rows, BLOCK), bool)
    bits[row, places] = True
    return np.packbits(bits, axis=1, bitorder="little")


def opened(column: pa.Array) -> np.ndarray:
    """(rows, bytes): the bitmaps of containers."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(bounds)
    out = np.zeros((len(column), _MAP), np.uint8)
    full = sizes == _MAP
    out[full] = data[bounds[:-1][full][:, None] + np.arange(_MAP)]
    thin = np.flatnonzero(~full)
    inner = np.arange(sizes[thin].sum()) - np.repeat(np.cumsum(sizes[thin]) - sizes[thin], sizes[thin])
    places = data[np.repeat(bounds[:-1][thin], sizes[thin]) + inner].view("<u2")
    out[thin] = _bitmaps(places, np.repeat(np.arange(len(thin)), sizes[thin] // 2), len(thin))
    return out


def closed(maps: np.ndarray) -> pa.Array:
    """Containers of bitmaps."""
    bits = np.unpackbits(maps, axis=1, bitorder="little")
    row, places = np.nonzero(bits)
    bounds = np.searchsorted(row, np.arange(len(maps) + 1))
    data = places.astype("<u2").tobytes()
    return pa.array([
        maps[i].tobytes() if 2 * (b - a) >= _MAP else data[2 * a:2 * b]
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist()))], pa.binary())


def popcount(maps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(maps.view(np.uint64)).sum(axis=1, dtype=np.int64)


_TOKENS = {"block": pa.int64(), "place": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
           "n_links": pa.int64(), "groups": pa.string(), "a": pa.int32(), "b": pa.int32(), "plane": pa.int32(),
           "bits": pa.binary()}
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _tokenised(byte_tokenizer: str, piece_model: bytes, spelled: bool, id_type: pa.DataType):
    """Rows of two kinds: one per document, and containers of the pairs of each block."""
    def rows(n: int, ids: pa.Array | None = None, **columns) -> pa.RecordBatch:
        arrays = [ids if ids is not None else pa.nulls(n, id_type)]
        arrays += [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TOKENS.items()]
        return pa.RecordBatch.from_arrays(arrays, ["id", *_TOKENS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number, first = Pieces(byte_tokenizer, piece_model), 0, TaskContext.get().partitionId() << 28
        held: list[tuple] = []          # (document's place, pair, times) of one block
        block = first

        def flush() -> pa.RecordBatch:
            doc, code, times = _entries(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            group, plane, bits = containers(doc, times, code)
            return rows(len(bits), block=np.full(len(bits), block), a=group >> 32, b=group & 0xFFFFFFFF, plane=plane, bits=bits)

        entries = 0
        for batch in slices(batches, "text", 2 << 20):
            sums, texts = np.zeros((batch.num_rows, 4), np.int64), [""] * batch.num_rows
            numbers = number + np.arange(batch.num_rows)
            open_doc: tuple | None = None       # (row, entries, digest, text so far, joint) of a text read in stretches
            for row, at, last in _read(pieces, batch.column(1)):
                if first + int(numbers[row]) // BLOCK != block:
                    if held:
                        yield flush()
                        entries = 0
                    block = first + int(numbers[row]) // BLOCK
                own, digest, said, behind = open_doc or ([], hashlib.sha256(), [], b"")
                sums[row] += pieces.sums[at, :4].sum(axis=0)
                part = behind + pieces.said[_runs(pieces.said_at[at], pieces.said_at[at + 1] - pieces.said_at[at])].tobytes()
                digest.update(part[:-1])
                said += [part[:-1]] * spelled
                codes = np.sort(pieces.codes[_runs(pieces.at[at], pieces.at[at + 1] - pieces.at[at])])
                starts = _starts(codes)
                own.append((np.full(len(starts), numbers[row] % BLOCK), codes[starts], np.diff(np.append(starts, len(codes)))))
                if len(own) > 1 and sum(len(x[0]) for x in own) > _MOST_ENTRIES:
                    own = [_entries(*(np.concatenate(x) for x in zip(*own)))]
                open_doc = (own, digest, said, b";")
                if last:
                    open_doc = None
                    texts[row] = b"".join(said).decode() if spelled else digest.hexdigest()
                    held += own
                    entries += sum(len(x[0]) for x in own)
                    if entries > _MOST_ENTRIES:
                        yield flush()
                        entries = 0
            yield rows(batch.num_rows, batch.column(0), block=first + numbers // BLOCK, place=numbers % BLOCK,
                       n_a=sums[:, 0], n_b=sums[:, 1], n_groups=sums[:, 2], n_links=sums[:, 3], groups=texts)
            number += batch.num_rows
        if held:
            yield flush()

    return run


def _read(pieces: Pieces, column: pa.Array) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(row, places of pieces, whether they end the text) of all texts that both tokenizers give back.

    Pieces of many texts are looked up together. A text of several stretches is read through first:
    if a piece of it is not given back, none of it counts.
    """
    held: list[tuple[int, list[str], bool]] = []

    def looked_up() -> Iterator[tuple[int, np.ndarray, bool]]:
        at = pieces.of([p for _, stretch, _ in held for p in stretch])
        bounds = np.cumsum([0] + [len(stretch) for _, stretch, _ in held]).tolist()
        for (row, _, last), a, b in zip(held, bounds[:-1], bounds[1:]):
            if not pieces.sums[at[a:b], 4].any():
                yield row, at[a:b], last
        held.clear()
        if pieces.full:
            pieces.clear()

    n = 0
    for row, text in enumerate(column.to_pylist()):
        if not text:
            continue
        if len(text) < _STRETCH:
            held.append((row, next(cut(text)), True))
            n += len(text)
            if n > _STRETCH:
                yield from looked_up()
                n = 0
            continue
        yield from looked_up()
        n = 0
        if pieces.whole(text):
            *stretches, end = cut(text)
            for stretch in stretches:
                held.append((row, stretch, False))
                yield from looked_up()
            held.append((row, end, True))
            yield from looked_up()
    yield from looked_up()


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of about `most` rows that do not part rows of one key."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            n += held[-1].num_rows
            if n < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.ones(n, bool)
            for key in keys:
                values = table[key].to_numpy()
                last &= values == values[-1]
            upto = n - int(last.sum())
            if upto:
                yield table.slice(0, upto)
            held = table.slice(upto).to_batches()
            n -= upto
    if n:
        yield pa.Table.from_batches(held)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers of one pair, block and plane OR-merged; `docs` and `links` on the first plane's row."""
    for table in _by_key(batches, ["block", "a", "b"], 2048):
        block, a, b, plane = (table[c].to_numpy() for c in ("block", "a", "b", "plane"))
        maps = opened(table["bits"].combine_chunks())
        first = _starts(block, a, b, plane)
        maps = np.bitwise_or.reduceat(maps, first, axis=0)
        block, a, b, plane = (x[first] for x in (block, a, b, plane))
        groups = _starts(block, a, b)
        docs, links = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        docs[groups] = popcount(np.bitwise_or.reduceat(maps, groups, axis=0))
        links[groups] = np.add.reduceat(popcount(maps) << plane.astype(np.int64), groups)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block), pa.array(a), pa.array(b), pa.array(plane), closed(maps), pa.array(docs), pa.array(links)],
            ["block", "a", "b", "plane", "bits", "docs", "links"])


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the pairs of a block return to its documents; rows of a block lie together."""
    block, best, total = None, np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)

    def settled() -> pa.RecordBatch:
        has = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(has), block), pa.int64()), pa.array(has, pa.int32()), pa.array(best[has]), pa.array(total[has])],
            ["block", "place", "n_best", "count_sum"])

    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            blocks, plane, links, is_best = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
            bits = np.unpackbits(opened(part.column(2)), axis=1, bitorder="little")
            starts = _starts(blocks)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(blocks)]):
                if block is not None and blocks[a] != block:
                    yield settled()
                    best[:], total[:] = 0, 0
                block = int(blocks[a])
                row, place = np.nonzero(bits[a:b])
                times = 1 << plane[a:b].astype(np.int64)
                np.add.at(total, place, (times * links[a:b])[row])
                np.add.at(best, place, (times * is_best[a:b])[row])
    if block is not None:
        yield settled()


@dataclass(frozen=True)
class Alignment:
    """`documents`: a row each; `pairs`: `a`, `b`, `docs`, `links`, `best` (no id of a links more with b)."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text",
          spelled: bool = False) -> Alignment:
    """Links between the tokens of a byte-level tokenizer (a) and of a piece model (b) in space and text.

    Of each document `id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best` (links whose pair has the most
    links among the pairs of its b id, ties too), `count_sum` (over links, the links of their pair in
    all documents) and `groups`: SHA-256 of the groups as text (`a1,a2|b1;a3|b2,b3`), or with `spelled`
    the text. A group ends where tokens of both end. Texts that are null or empty, or that either
    tokenizer does not give back byte by byte, have no tokens: zeros and ''. Rows that repeat, ids too,
    are documents of their own. A long text is read in stretches, and its pairs are added up on the way.
    """
    with open(byte_file, encoding="utf-8") as file:        # the driver's files go with the tasks
        byte_tokenizer = file.read()
    with open(piece_file, "rb") as file:
        piece_model = file.read()
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kind = given.schema["id"].dataType
    ddl = ", ".join(f"{c} {_KINDS[t]}" for c, t in _TOKENS.items())
    found = stored(given.mapInArrow(
        _tokenised(byte_tokenizer, piece_model, spelled, to_arrow_type(kind)), f"id {kind.simpleString()}, {ddl}"), "tokens")

    key = ("block", "a", "b")
    merged = stored(
        found.where("a is not null").select(*key, "plane", "bits").repartition(*key).sortWithinPartitions(*key, "plane")
        .mapInArrow(_merged, "block long, a int, b int, plane int, bits binary, docs long, links long"), "bitmaps")
    counts = merged.groupBy("a", "b").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    pairs = stored(
        counts.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b"))), "pairs")

    returned = (
        merged.select(*key, "plane", "bits").join(pairs, ["a", "b"])
        .select("block", "plane", "bits", "links", F.col("best").cast("long").alias("is_best"))
        .repartition("block").sortWithinPartitions("block")
        .mapInArrow(_returned, "block long, place int, n_best long, count_sum long")
    )
    zero = F.lit(0).cast("long")
    documents = found.where("place is not null").select(
        "id", "block", "place", "n_a", "n_b", "n_groups", "n_links", "groups",
    ).join(returned, ["block", "place"], "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups")
    return Alignment(documents, pairs)
