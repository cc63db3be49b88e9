"""Sampled SentencePiece segmentations without replacement, and their decoding.

The lattice of a text has a node at every character and an edge for every vocabulary piece. Edge
weights are a unigram model of the pieces; with the mass of all ways from a node to the end, an edge
has a chance given its node, and a path's log chance is the sum over its edges. Gumbel top-k: give
every segmentation its log chance plus Gumbel noise, and take the k largest. The search is A-star from
the top: the largest value under a set of paths is itself Gumbel distributed around the log mass of
the set, so values are drawn for sets first. A set is taken off the queue, its best path is drawn
down the lattice and inherits the value, and what the path left aside at every node goes on the queue,
with a value drawn below that of the path. The next value on the queue after k paths is the threshold
that inclusion scores need.

Between two characters that follow each other in no piece, no edge crosses: there the lattice of a
text is cut into a chain of small lattices, here called words. Equal words share theirs, and the words
of many texts are walked at once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from eventloom.llm.common import slices

# Fixed value: the mark that stands for a space.
SPACE = "▁"
_U = np.uint64
_LEAST_NOISE = math.log(-math.log1p(-2.0 ** -54)) - 1e-6
_REACH = 60.0
_IDS = 100_000
# Lattices that a worker keeps, in edges (32 bytes each); beyond, it begins anew.
_MOST_EDGES = 1_000_000


def _round(x: np.ndarray, part) -> np.ndarray:
    x = (x ^ np.asarray(part).astype(_U)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _mixed(*key) -> np.ndarray:
    x = np.full(1, 0x632BE59BD9B4E019, _U)
    for part in key:
        x = _round(x, part)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> _U(11)).astype(float) + 0.5) / float(1 << 53)


def _noise(*key) -> np.ndarray:
    """Numbers in (0, 1) from a key of whole numbers."""
    return _unit(_mixed(*key))


class Vocabulary:
    """Pieces and weights of a model. A piece's chance falls with its rank, as 1 / (rank + 2.7)."""

    def __init__(self, model: bytes, sharpness: float = 1.0):
        loaded = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = loaded.get_piece_size()
        plain = [i for i in range(size) if not (
            loaded.is_byte(i) or loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-loaded.get_score(i), i))
        norm = math.log(sum(1 / (r + 2.7) for r in range(len(ranked))))
        self.text = [loaded.id_to_piece(i) for i in range(size)]
        self.pieces = {self.text[i]: (i, sharpness * (-math.log(r + 2.7) - norm)) for r, i in enumerate(ranked)}
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(size) if loaded.is_byte(i)}
        self.byte_weight = sharpness * (-math.log(len(ranked) + 2.7) - norm - 1)
        self._spell(size)

    def _spell(self, size: int) -> None:
        """What every id stands for when it is decoded."""
        spelled = [b""] * size
        for piece, (i, _) in self.pieces.items():
            spelled[i] = piece.replace(SPACE, " ").encode()
        for byte, i in self.byte_ids.items():
            spelled[i] = bytes([byte])
        self.spelled_at = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    def index(self) -> None:
        """A tree of the pieces' beginnings, and which characters follow each other in a piece."""
        chars = sorted({c for p in self.pieces for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        self.joined = np.zeros((self.kinds, self.kinds), bool)
        states, steps = {"": 0}, {}
        for piece in self.pieces:
            codes = self.kind[[ord(c) for c in piece]]
            self.joined[codes[:-1], codes[1:]] = True
            for n, code in enumerate(codes.tolist()):
                state = states[piece[:n]]
                steps[state * self.kinds + code] = states.setdefault(piece[:n + 1], len(states))
        self.step_keys = np.array(sorted(steps), np.int64)
        self.step_to = np.array([steps[k] for k in self.step_keys.tolist()], np.int64)
        self.piece_at = np.full(len(states), -1, np.int64)
        self.weight_at = np.zeros(len(states))
        for piece, (i, weight) in self.pieces.items():
            self.piece_at[states[piece]], self.weight_at[states[piece]] = i, weight

    def normalised(self, text: str) -> str:
        """Spaces become the mark, and one is put in front; an empty text stays empty."""
        return SPACE + text.replace(" ", SPACE) if text else ""


class _Lattices:
    """Lattices of many words, as arrays. Edges of a node lie together, likeliest first."""

    _KINDS = {"cum": float, "gain": float, "rest": float, "next": np.int32, "id_at": np.int32}

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        vocabulary.index()
        # Ids that edges point into, and how many follow; characters spelled in bytes come behind.
        self.pool = list(range(len(vocabulary.text)))
        self.span = [1] * len(self.pool)
        self.spelled: dict[int, tuple[int, int]] = {}
        self.clear()

    def clear(self) -> None:
        self.begin: dict[int, int] = {}
        self.nodes = {name: np.zeros(0, np.int32) for name in ("first", "upto")}
        self.n_nodes = self.n_edges = 0
        self.edges = {name: np.zeros(0, kind) for name, kind in self._KINDS.items()}

    @staticmethod
    def _append(arrays: dict[str, np.ndarray], have: int, new: dict[str, np.ndarray]) -> int:
        """Arrays grow by a quarter; what is behind the end is not used."""
        upto = have + len(next(iter(new.values())))
        for name, values in new.items():
            if len(arrays[name]) < upto:
                wider = np.zeros(upto + upto // 4, arrays[name].dtype)
                wider[:have] = arrays[name][:have]
                arrays[name] = wider
            arrays[name][have:upto] = values
        return upto

    def _bytes(self, code: int) -> tuple[int, int]:
        if code not in self.spelled:
            ids = [self.vocabulary.byte_ids[b] for b in chr(code).encode()]
            self.spelled[code] = len(self.pool), len(ids)
            self.pool.extend(ids)
            self.span.extend([len(ids)] * len(ids))
        return self.spelled[code]

    def _found(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """Edges from every character: (character, length, weight, id_at)."""
        v, out = self.vocabulary, []
        kinds = v.kind[codes].astype(np.int64)
        at, state, length = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        alone = np.zeros(len(codes), bool)
        while len(at):
            key = state * v.kinds + kinds[at + length]
            step = np.minimum(np.searchsorted(v.step_keys, key), len(v.step_keys) - 1)
            hit = v.step_keys[step] == key
            at, state, length = at[hit], v.step_to[step[hit]], length + 1
            piece = v.piece_at[state]
            full = piece >= 0
            if length == 1:
                alone[at[full]] = True
            n = int(full.sum())
            out.append((at[full], np.full(n, length), v.weight_at[state[full]], piece[full]))
            goes = at + length < stop[at]
            at, state = at[goes], state[goes]
        odd = np.flatnonzero(~alone)
        if len(odd):
            spans = np.array([self._bytes(c) for c in codes[odd].tolist()], np.int64)
            out.append((odd, np.ones(len(odd), np.int64), v.byte_weight * spans[:, 1], spans[:, 0]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def add(self, names: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Lattices of new words, all together: masses are summed from the ends of the words on."""
        ends = np.cumsum(sizes)
        stop = np.repeat(ends, sizes)
        node, length, weight, id_at = self._found(codes, stop)
        left = stop[node] - node                        # characters from the node to the end
        order = np.argsort(left * len(codes) + node)
        node, length, weight, id_at, left = (x[order] for x in (node, length, weight, id_at, left))
        starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        rounds = np.searchsorted(left, np.arange(1, int(left[-1]) + 2))
        mass = np.zeros(len(codes) + 1)
        to, over = node + length, length == left
        values = weight.copy()
        mass_of = np.zeros(len(node))
        firsts = np.searchsorted(starts, rounds)
        for lo, hi, s, e in zip(rounds[:-1].tolist(), rounds[1:].tolist(), firsts[:-1].tolist(), firsts[1:].tolist()):
            if lo == hi:
                continue
            v = values[lo:hi]
            v += np.where(over[lo:hi], 0.0, mass[to[lo:hi]])
            cuts = starts[s:e] - lo
            counts = np.diff(np.append(cuts, hi - lo))
            top = np.maximum.reduceat(v, cuts)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, counts)), cuts))
            mass[node[lo:hi][cuts]] = total
            mass_of[lo:hi] = np.repeat(total, counts)
        gain = values - mass_of
        share = np.exp(gain)
        order = np.argsort(node + (1 - np.minimum(share, 1.0)) * 0.999, kind="stable")
        node, gain, share, to, over, id_at = (x[order] for x in (node, gain, share, to, over, id_at))
        first = np.searchsorted(node, np.arange(len(codes) + 1))
        sums = np.concatenate(([0.0], np.cumsum(share)))
        cum = sums[1:] - sums[first[node]]
        cum[first[1:] - 1] = np.inf
        # The mass beside an edge; beside the likeliest, where 1 - share would round to nothing, summed.
        others, rest = share.copy(), 1 - share
        others[first[:-1]] = 0.0
        rest[first[:-1]] = np.add.reduceat(others, first[:-1])
        base, edge_base = self.n_nodes, self.n_edges
        self.n_edges = self._append(self.edges, edge_base, {
            "cum": cum, "gain": gain, "rest": rest, "next": np.where(over, -1, to + base), "id_at": id_at})
        self.n_nodes = self._append(self.nodes, base, {"first": first[:-1] + edge_base, "upto": first[1:] + edge_base})
        self.begin.update(zip(names.tolist(), (ends - sizes + base).tolist()))

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """For every text the first nodes of its words. A text is cut between characters that follow
        each other in no piece: no edge crosses there."""
        v, begin = self.vocabulary, self.begin
        whole = [v.normalised(t) for t in texts]
        joined = "".join(whole)
        if not joined:
            return [np.zeros(0, np.int64) for _ in texts]
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = v.kind[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~v.joined[kinds[:-1], kinds[1:]]
        bounds = np.concatenate(([0], np.cumsum([len(w) for w in whole])))
        cut[bounds[:-1][np.diff(bounds) > 0]] = True
        at = np.flatnonzero(cut)
        sizes = np.diff(np.append(at, len(codes)))
        names, firsts, which = np.unique(self._names(codes, at, sizes), return_index=True, return_inverse=True)
        nodes = [begin.get(n, -1) for n in names.tolist()]
        new = np.flatnonzero(np.array(nodes) < 0)
        if len(new):
            some, n = at[firsts[new]], sizes[firsts[new]]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.add(names[new], codes[np.repeat(some, n) + inner], n)
            nodes = [begin[n] for n in names.tolist()]
        words = np.array(nodes, np.int64)[which]
        places = np.searchsorted(at, bounds)
        return [words[i:j] for i, j in zip(places[:-1].tolist(), places[1:].tolist())]

    @staticmethod
    def _names(codes: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """64-bit names of words: equal words have equal names."""
        powers = np.cumprod(np.full(int(sizes.max()), 0xD1342543DE82EF95, _U))
        inner = np.arange(len(codes)) - np.repeat(at, sizes)
        terms = (codes.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
        sums = np.add.reduceat((terms ^ (terms >> _U(29))) * powers[inner], at)
        return _round(sums, sizes)

    def arrays(self) -> dict[str, np.ndarray]:
        return {**self.edges, **{n: x[:self.n_nodes] for n, x in self.nodes.items()},
                "pool": np.array(self.pool, np.int32), "span": np.array(self.span, np.int64)}


def _walk(a: dict, node: np.ndarray, key: np.ndarray, barred: dict[int, np.ndarray]):
    """Draw edges from each start node to the end of its word, all words together.

    `barred`: for some walks the edges of the first node that may not be taken. Gives the edge and the
    mass left aside at each step, ordered by walk and step, and where each walk begins.
    """
    walks, taken = np.arange(len(node)), []
    steps, corrected = np.zeros(len(node), np.int64), {}
    while len(walks):
        draw = _unit(_round(key, len(taken)))
        edge = a["first"][node].astype(np.int64)
        if not taken:
            for w, gone in barred.items():
                own = np.arange(edge[w], a["upto"][node[w]])
                free = np.setdiff1d(own, gone)
                sums = np.cumsum(np.exp(a["gain"][free]))
                chosen = min(int(np.searchsorted(sums, draw[w] * sums[-1], side="right")), len(free) - 1)
                corrected[w] = float(sums[-1] - np.exp(a["gain"][free[chosen]])) if len(free) > 1 else 0.0
                edge[w], draw[w] = free[chosen], -1.0
        more = np.flatnonzero(draw >= a["cum"][edge])
        while len(more):
            edge[more] += 1
            more = more[draw[more] >= a["cum"][edge[more]]]
        taken.append((walks, edge))
        steps[walks] += 1
        node = a["next"][edge]
        goes = np.flatnonzero(node >= 0)
        walks, node, key = walks[goes], node[goes], key[goes]
    at = np.concatenate(([0], np.cumsum(steps)))
    edges = np.empty(at[-1], np.int64)
    for n, (walks, edge) in enumerate(taken):
        edges[at[walks] + n] = edge
    return edges, {int(at[w]): max(left, 0.0) for w, left in corrected.items()}, at


def _ranks(a: dict, edges: np.ndarray, corrected: dict[int, float], sums: np.ndarray, of: np.ndarray,
           begins: np.ndarray, seeds: np.ndarray, sample: int, where: np.ndarray) -> np.ndarray:
    """For the sets left aside at some places of the paths: log E - log mass, as `_queue` wants them."""
    aside = a["rest"][edges[where]]
    for place, left in corrected.items():
        i = int(np.searchsorted(where, place))
        if i < len(where) and where[i] == place:
            aside[i] = left
    owner = of[where]
    noise = _unit(_round(_mixed(seeds[owner], 1 << 40, sample), where - begins[owner]))
    with np.errstate(divide="ignore"):
        return np.log(-np.log(noise)) - np.log(aside) - sums[where]


class _Text:
    """Search state of one text."""

    __slots__ = ("words", "queue", "found", "seed")

    def __init__(self, words: np.ndarray, seed: int):
        self.words, self.seed = words, seed
        self.queue: list[tuple] = []
        self.found: list[dict] = []


def _queue(text: _Text, path: dict, places: np.ndarray, ranks: np.ndarray, room: int) -> None:
    """Queue the sets that a path leaves aside, the `room` best: no others can come up.

    The value of a set with log mass m, given that it is below v, is -log(exp(-v) + E exp(-m)) with E
    exponential; it falls with log E - m, which is `ranks`, so the smallest of those are looked for.
    """
    at = np.argpartition(ranks, room - 1)[:room] if len(ranks) > room else np.arange(len(ranks))
    for i, rank in zip(places[at].tolist(), ranks[at].tolist()):
        if rank < math.inf:
            value = -float(np.logaddexp(-path["value"], rank))
            gone = (path["barred"] if i == 0 else ()) + (int(path["edges"][i]),)
            heapq.heappush(text.queue, (-value, len(text.found) - 1, i + path["from"], gone))


def sample_batch(lattices: _Lattices, texts: list[str], seeds: list[int], k: int) -> list[list[tuple]]:
    """Per text up to k paths (ids, log_prob, perturbed, log_inclusion); all texts go together."""
    if lattices.n_edges > _MOST_EDGES:
        lattices.clear()
    states = [_Text(words, seed & ((1 << 64) - 1)) for words, seed in zip(lattices.words(texts), seeds)]
    a = lattices.arrays()
    root = -np.log(-np.log(_noise(np.array([s.seed for s in states], _U), 1 << 41)))
    todo = [(s, float(v), None, 0, ()) for s, v in zip(states, root) if len(s.words)]
    for sample in range(k):
        # Draw the rest of every path: the word it turns off in, from the turn on, and all words after.
        nodes, owners, places, lengths, barred = [], [], [], [], {}
        total = 0
        for i, (state, value, parent, turn, edges) in enumerate(todo):
            if parent is None:
                mine, offset = state.words, 0
            else:
                offset = int(parent["word"][turn])
                node = np.searchsorted(a["first"], parent["all"][turn].astype(np.int32), side="right") - 1
                mine = np.concatenate(([node], state.words[offset + 1:]))
                barred[total] = np.array(edges)
            nodes.append(mine)
            owners.append(np.full(len(mine), i))
            places.append(np.arange(offset, offset + len(mine)))
            lengths.append(len(mine))
            total += len(mine)
        if not total:
            break
        owner, place = np.concatenate(owners), np.concatenate(places)
        seeds = np.array([t[0].seed for t in todo], _U)
        ahead = np.array([0.0 if t[2] is None else t[2]["sums"][t[3]] for t in todo])
        edges, corrected, at = _walk(a, np.concatenate(nodes), _round(_mixed(seeds, sample)[owner], place), barred)
        cuts = at[np.concatenate(([0], np.cumsum(lengths)))]
        word_of, of = np.repeat(place, np.diff(at)), np.repeat(owner, np.diff(at))
        gains = np.concatenate(([0.0], np.cumsum(a["gain"][edges])))
        before = gains[:-1] + (ahead - gains[cuts[:-1]])[of]
        # No noise has a log below _LEAST_NOISE, so a set far down cannot pass what is found further up.
        near = np.flatnonzero(before - ahead[of] > -_REACH)
        ranks = _ranks(a, edges, corrected, before, of, cuts[:-1], seeds, sample, near)
        spans = np.searchsorted(near, cuts)
        for i, (state, value, parent, turn, banned) in enumerate(todo):
            lo, hi = int(cuts[i]), int(cuts[i + 1])
            path = {"value": value, "from": turn, "edges": edges[lo:hi], "barred": banned}
            sums = np.append(before[lo:hi], ahead[i] + gains[hi] - gains[lo])
            if parent is None:
                path |= {"all": path["edges"], "word": word_of[lo:hi], "sums": sums}
            else:
                path |= {"all": np.concatenate((parent["all"][:turn], path["edges"])),
                         "word": np.concatenate((parent["word"][:turn], word_of[lo:hi])),
                         "sums": np.concatenate((parent["sums"][:turn], sums))}
            state.found.append(path)
            room, own = k - sample, slice(int(spans[i]), int(spans[i + 1]))
            places, some = near[own] - lo, ranks[own]
            if len(places) < hi - lo and (
                    len(some) < room or np.partition(some, room - 1)[room - 1] > _REACH - ahead[i] + _LEAST_NOISE):
                places = np.arange(hi - lo)
                some = _ranks(a, edges, corrected, before, of, cuts[:-1], seeds, sample, places + lo)
            _queue(state, path, places, some, room)
        todo = []
        if sample + 1 < k:
            for state in states:
                if state.queue:
                    value, parent, turn, edges = heapq.heappop(state.queue)
                    todo.append((state, -value, state.found[parent], turn, edges))

    out = []
    for state in states:
        limit = -state.queue[0][0] if state.queue else -math.inf
        rows = []
        for path in state.found:
            log_prob = float(path["sums"][-1])
            rows.append((_spell(a, path["all"]), log_prob, path["value"], _log_inclusion(log_prob - limit)))
        if not rows:       # an empty text has one segmentation, the empty one
            rows.append((np.zeros(0, np.int32), 0.0, 0.0, 0.0))
        out.append(rows)
    return out


def _log_inclusion(excess: float) -> float:
    """log of 1 - exp(-exp(excess)): the chance that a path's value is above the threshold."""
    if excess > 40:
        return 0.0
    if excess < -30:
        return excess
    return math.log(-math.expm1(-math.exp(excess)))


def _spell(a: dict, edges: np.ndarray) -> np.ndarray:
    at = a["id_at"][edges]
    n = a["span"][at]
    if (n == 1).all():
        return a["pool"][at].astype(np.int32)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a["pool"][np.repeat(at, n) + inner].astype(np.int32)


_LOADED: dict[tuple[int, float], Vocabulary] = {}
_LATTICES: dict[tuple[int, float], _Lattices] = {}


def _vocabulary(model: bytes, sharpness: float) -> Vocabulary:
    """Once per worker process."""
    key = (hash(model), sharpness)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(model, sharpness)
    return _LOADED[key]


def _lattices(model: bytes, sharpness: float) -> _Lattices:
    """Once per worker process; the words of a task are let go of at its end."""
    key = (hash(model), sharpness)
    if key not in _LATTICES:
        _LATTICES[key] = _Lattices(_vocabulary(model, sharpness))
    return _LATTICES[key]


def encode(docs: DataFrame, model_file: str, k: int = 4, id_col: str = "doc_id", text_col: str = "text",
           sharpness: float = 1.0, seed: int = 29, decoded: bool = False) -> DataFrame:
    """`id`, `sample` (from 1), `ids`, `log_prob`, `perturbed`, `log_inclusion`: k rows per document.
    With `decoded` also the text that the ids spell, as `decode` has it, from the same worker.

    The samples of a document are different segmentations of its whole text, best perturbed value
    first; fewer come where the text has fewer. `log_inclusion` is the log chance of being among the
    samples, given the threshold; it is 0 where all segmentations came. A null or empty text has one
    segmentation, without pieces. Draws hang on the id alone, so rows that repeat an id and text
    repeat their samples; a null id is a value like others. `sharpness` multiplies the weights.
    """
    with open(model_file, "rb") as file:        # the driver's file; half a megabyte goes with the tasks
        model = file.read()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("seed"),
                       F.col(text_col).alias("text"))

    names = ["id", "sample", "ids", "log_prob", "perturbed", "log_inclusion", *["decoded"] * decoded]

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(model, sharpness)
        for batch in slices(batches, "text", 1 << 18):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = sample_batch(lattices, texts, batch.column(1).to_pylist(), k)
            counts = [len(rows) for rows in found]
            flat = [row for rows in found for row in rows]
            ids = np.concatenate([ids for ids, *_ in flat])
            bounds = np.concatenate(([0], np.cumsum([len(ids) for ids, *_ in flat])))
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), counts))),
                pa.array(np.concatenate([np.arange(1, n + 1) for n in counts]), pa.int32()),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                *(pa.array([row[i] for row in flat], pa.float64()) for i in (1, 2, 3)),
            ]
            if decoded:
                columns.append(pa.array(decode_ids(lattices.vocabulary, ids, bounds), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)
        lattices.clear()        # a worker that waits for another task holds the vocabulary only

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        sampled, f"id {kind}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double"
        + ", decoded string" * decoded)


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts of runs of ids; the one space that encoding put in front goes."""
    at, texts, row = vocabulary.spelled_at, [], 0
    while row < len(bounds) - 1:        # some runs at a time: a byte takes 24 while it is looked up
        upto = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _IDS, side="right")) - 1)
        own, cuts = ids[bounds[row]:bounds[upto]], bounds[row:upto + 1] - bounds[row]
        sizes = (at[1:] - at[:-1])[own]
        before = np.concatenate(([0], np.cumsum(sizes)))
        data = vocabulary.spelled[np.repeat(at[own] - before[:-1], sizes) + np.arange(before[-1])].tobytes()
        edges = before[cuts].tolist()
        texts += [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(edges[:-1], edges[1:])]
        row = upto
    return texts


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns, and the text that the ids spell; null ids give null, none give the empty text.

    The mark for a space reads as a space, wherever it stood in the text that was encoded. Bytes that
    are no UTF-8 become the replacement character.
    """
    with open(model_file, "rb") as file:
        model = file.read()
    if text_col in encoded.columns:
        raise ValueError(f"there is a column {text_col} already")
    names = [*encoded.columns, text_col]
    place = encoded.columns.index(ids_col)

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model, 1.0)
        for whole in batches:
            column = whole.column(place)
            some = column.fill_null([]) if column.null_count else column
            bounds, ids = some.offsets.to_numpy(), some.values.to_numpy(zero_copy_only=False)
            gone = column.is_null().to_pylist()
            texts = [None if g else t for t, g in zip(decode_ids(vocabulary, ids, bounds), gone)]
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(texts, pa.string())], names)

    return encoded.mapInArrow(spelled, StructType(encoded.schema.fields[:]).add(text_col, StringType()))
