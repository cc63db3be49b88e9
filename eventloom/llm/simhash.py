"""Near duplicates by SimHash fingerprints and an inverted index over byte positions.

Two fingerprints of eight bytes that differ in at most two bits share at least six bytes in place:
that is the least number of matches. The index holds every fingerprint under each choice of six byte
positions with their bytes, so two fingerprints meet in a posting list exactly when their tally of
shared positional bytes reaches six. What can still differ in a list are two bytes, so a list has at
most 65,536 different fingerprints whatever the corpus, and links in it are found by looking up the
neighbours at one and two bits: no pairs are formed, and a list gives one row per linked fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import slices, stored
from eventloom.llm.components import connected_components

SHINGLE, SEED, MOST_BITS = 3, 42, 2
_BLOCK = 1 << 16
_LANES = np.uint64(0x0101010101010101)
#: The byte positions that a posting list leaves open.
OPEN_BYTES = tuple(combinations(range(8), MOST_BITS))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of every word shingle of a text, in blocks; a short text is one shingle."""
    words = text.lower().split()
    if not words:
        return
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    for at in range(0, len(words) - span + 1, _BLOCK):
        upto = min(at + _BLOCK, len(words) - span + 1)
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(
            starts[at:upto].tolist(), ends[at + span - 1:upto + span - 1].tolist())], np.uint64)


def bit_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set between bounds: bytes are summed as lanes of one number."""
    lengths = np.diff(bounds)
    pieces = -(-lengths // 255)
    first = np.concatenate(([0], np.cumsum(pieces)))
    inner = np.arange(first[-1]) - np.repeat(first[:-1], pieces)
    cuts = np.repeat(bounds[:-1], pieces) + 255 * inner
    out = np.zeros((len(lengths), 8, 8), np.int64)
    if len(cuts):
        for bit in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, cuts)
            counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
            full = np.flatnonzero(pieces)
            out[full, :, bit] = np.add.reduceat(counts, first[:-1][full], axis=0)
    return out.reshape(len(lengths), 64)


def fingerprint_batch(texts: list[bytes]) -> np.ndarray:
    """Signed 64-bit fingerprints; a text without words has 0."""
    totals, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held, owner, weight = [], [], 0

    def flush():
        if held:
            bounds = np.concatenate(([0], np.cumsum([len(h) for h in held])))
            np.add.at(totals, owner, bit_counts(np.concatenate(held), bounds))
            held.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for block in shingle_hashes(text):
            held.append(block)
            owner.append(i)
            sizes[i] += len(block)
            weight += len(block)
            if weight >= _BLOCK:
                flush()
                weight = 0
    flush()
    bits = (2 * totals > sizes[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fingerprint_batch(texts), pa.int64())], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, `fp` (signed 64 bits) for every row; null texts have no words."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


_NEAR = np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))], np.uint16)


def local_roots(values: np.ndarray) -> np.ndarray:
    """For distinct 16-bit values, the first index of each one's component at two bits or fewer."""
    slot = np.full(1 << 16, -1, np.int64)
    slot[values] = np.arange(len(values))
    roots = np.full(len(values), -1, np.int64)
    for i in range(len(values)):
        if roots[i] >= 0:
            continue
        roots[i], edge = i, np.array([i])
        while len(edge):
            met = slot[(values[edge][:, None] ^ _NEAR).ravel()]
            met = np.unique(met[met >= 0])
            edge = met[roots[met] < 0]
            roots[edge] = i
    return roots


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (open, shared, fp): posting lists one after the other."""
    held = [np.zeros(0, np.int64)] * 3

    def lists(open_bytes, shared, fp):
        new = np.ones(len(fp), bool)
        new[1:] = (open_bytes[1:] != open_bytes[:-1]) | (shared[1:] != shared[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(fp))
        a, b = [], []
        many = np.flatnonzero(ends - starts > 1)
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            i, j = OPEN_BYTES[open_bytes[s]]
            bits = fp[s:e].view(np.uint64)
            values = ((bits >> np.uint64(8 * i)) & np.uint64(255)) | (((bits >> np.uint64(8 * j)) & np.uint64(255)) << np.uint64(8))
            roots = local_roots(values.astype(np.uint16))
            linked = np.flatnonzero(roots != np.arange(e - s))
            a.append(fp[s:e][linked])
            b.append(fp[s:e][roots[linked]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        columns = [np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False)))
                   for i, h in enumerate(held)]
        if not len(columns[2]):
            continue
        # The last list may go on in the next batch.
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        yield lists(*(c[:cut] for c in columns))
        held = [c[cut:] for c in columns]
    if len(held[2]):
        yield lists(*held)


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """`a`, `b`: enough links between different fingerprints (`fp`) to join all that are near."""
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = []
    for n, pair in enumerate(OPEN_BYTES):
        mask = (1 << 64) - 1
        for byte in pair:
            mask &= ~(255 << (8 * byte))
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        entries.append(F.struct(F.lit(n).cast("long").alias("open"), F.col("fp").bitwiseAND(F.lit(signed)).alias("shared")))
    postings = distinct.select("fp", F.explode(F.array(*entries)).alias("e")).select("e.open", "e.shared", "fp")
    return (
        postings.repartition(parts, "open", "shared")
        .sortWithinPartitions("open", "shared", "fp")
        .mapInArrow(_links, "a long, b long")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id`, `fp`, `component_id` (smallest id reachable over links of two bits or fewer) for every row.

    Rows with equal fingerprints are linked, texts without words too (fingerprint 0). Null ids have a
    component like others, but name one only where it has no other id. Rows that repeat are kept.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = connected_components(fingerprint_links(classes.select("fp")))
    placed = stored(
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    names = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = stored(placed.join(names, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("id", "fp", "component_id")
