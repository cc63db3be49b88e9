"""Hard negatives by exact inner products, scored with tables of subset sums (Four Russians).

The whole components of the candidates are cut into bit planes of their two's complement, and the bits
of eight dimensions make a byte. For every anchor and group of eight dimensions a table holds the sums
of all 256 subsets of the anchor's components. A candidate's byte in a plane picks one sum per group;
these are added up, and the planes are shifted and added from the sign down, which gives the whole
exact product. Candidates lie in shards and anchors in blocks; every block meets every shard, once for
the positives and, when these are known over all shards, once for the negatives in their bands.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import parts_for, stored

_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1
#: Anchors whose tables are held at once, and candidates scored at once: about a megabyte each.
_ANCHORS, _CHUNK = 128, 2048


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, shift_every: int,
                  labels: int) -> DataFrame:
    """`vec_id`, `label`, `v`: floor(scale * x) of every component, labels after the stated shift."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # Doubles from 2^53 on are whole already, and would not fit the long that floor gives.
    floor = lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * float(scale))
    own, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    return (
        vectors.select(own.alias("vec_id"), F.when(own % shift_every == 0, (label + 1) % labels).otherwise(label).alias("label"),
                       scaled.alias("v"))
        .where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
        .select("vec_id", "label", F.transform("v", floor).alias("v"))
    )


def bit_planes(points: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of whole numbers (rows, dimensions); the last plane is the sign."""
    most = max((abs(int(points.max())), abs(int(points.min()))), default=0) if points.size else 0
    groups = -(-points.shape[1] // 8)
    planes = np.zeros((most.bit_length() + 1, groups, len(points)), np.uint8)
    for p in range(len(planes)):
        bits = ((points >> p) & 1).astype(np.uint8)
        planes[p] = np.packbits(bits, axis=1, bitorder="little").T
    return planes


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): at a byte the sum of the anchor's components whose bits are set."""
    groups = -(-anchors.shape[1] // 8)
    tables = np.zeros((groups, 256, len(anchors)), anchors.dtype)
    for d in range(anchors.shape[1]):
        g, i = divmod(d, 8)
        tables[g, 1 << i:2 << i] = tables[g, :1 << i] + anchors[:, d]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact products, by one look-up per plane and group and a shift per plane."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    picked = np.empty_like(total)
    for p in range(len(planes) - 1, -1, -1):
        if p < len(planes) - 1:
            total += total
        for g in range(len(tables)):
            np.take(tables[g], planes[p, g], axis=0, out=picked, mode="clip")
            if p == len(planes) - 1:
                total -= picked
            else:
                total += picked
    return total


def _fitting(anchors: np.ndarray, planes: int) -> np.ndarray:
    """Anchors in the smallest type in which no sum on the way can overflow."""
    most = max((abs(int(x)) for x in (anchors.max(), anchors.min())), default=0) if anchors.size else 0
    bound = (anchors.shape[1] * most) << (planes + 1)
    return anchors.astype(np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object)


def _whole(points: np.ndarray) -> np.ndarray:
    """Whole doubles as numbers that can be shifted."""
    if not points.size or np.abs(points).max() < _EXACT:
        return points.astype(np.int64)
    return np.array([int(x) for x in points.ravel()], object).reshape(points.shape)


def _saved(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a partition by length of vector: (dim, ids, labels, points), ids in order."""
    held: dict[int, list] = {}
    for batch in batches:
        ids, labels, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        bounds, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        sizes = np.diff(bounds)
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            points = flat[bounds[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))
            held.setdefault(dim, []).append((ids[rows], labels[rows], points))
    for dim, pieces in held.items():
        ids, labels, points = (np.concatenate(x) for x in zip(*pieces))
        order = np.argsort(ids, kind="stable")
        yield dim, ids[order], labels[order], points[order]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, ids, labels, points in _gathered(batches):
        packed = _saved(ids=ids, labels=labels, planes=bit_planes(_whole(points)))
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "rows": pa.array([packed], pa.binary())})


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for dim, ids, labels, points in _gathered(batches):
        packed = _saved(ids=ids, labels=labels, points=points)
        yield pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()), "block": pa.array([TaskContext.get().partitionId()], pa.int32()),
            "anchors": pa.array([packed], pa.binary())})


def _scored(shard: dict, anchors: dict) -> Iterator[tuple[int, np.ndarray]]:
    """(place of an anchor, its scores with every row of the shard), kept to the range of a long."""
    planes, points = shard["planes"], _whole(anchors["points"])
    for at in range(0, len(points), _ANCHORS):
        tables = subset_sums(_fitting(points[at:at + _ANCHORS], len(planes)))
        found = np.empty((tables.shape[2], planes.shape[2]), tables.dtype)
        for row in range(0, planes.shape[2], _CHUNK):
            found[:, row:row + _CHUNK] = scores(tables, planes[:, :, row:row + _CHUNK]).T
        if found.dtype == object:
            found = np.array([max(-_LONG, min(_LONG, x)) for x in found.ravel()], np.int64).reshape(found.shape)
        for i, own in enumerate(found):
            yield at + i, own


def _highest(score: np.ndarray, allowed: np.ndarray, k: int) -> list[int]:
    """Places of the k highest allowed scores; of equal ones the first, and rows lie by id."""
    least = np.iinfo(score.dtype).min
    left, out = np.where(allowed, score, least), []
    for _ in range(min(k, int(np.count_nonzero(allowed)))):
        best = int(left.argmax())
        left[best] = least
        out.append(best)
    return out


def _tiles(shards: pa.Table, blocks: pa.Table) -> Iterator[tuple[dict, dict, dict]]:
    for packed in blocks.to_pylist():
        anchors = dict(np.load(io.BytesIO(packed["anchors"])))
        for rows in shards["rows"].to_pylist():
            yield dict(np.load(io.BytesIO(rows))), anchors, packed


_FOUND = {"dim": "int", "block": "int", "place": "int", "nth": "int", "anchor_id": "long", "positive_id": "long",
          "positive_score": "long", "vec_id": "long", "score": "long"}
_FOUND_DDL = ", ".join(f"{n} {t}" for n, t in _FOUND.items())


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(_FOUND)
    kinds = [pa.int32() if t == "int" else pa.int64() for t in _FOUND.values()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], list(_FOUND))


def _positives(k: int):
    def search(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        for shard, anchors, packed in _tiles(shards, blocks):
            ids, labels = anchors["ids"].tolist(), anchors["labels"].tolist()
            for place, score in _scored(shard, anchors):
                allowed = (shard["labels"] == labels[place]) & (shard["ids"] != ids[place])
                for best in _highest(score, allowed, k):
                    rows.append((packed["dim"], packed["block"], place, 0, ids[place], None, None,
                                 int(shard["ids"][best]), int(score[best])))
        return _table(rows)

    return search


def _negatives(k: int, band: tuple[int, int]):
    def search(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        for shard, anchors, packed in _tiles(shards, blocks):
            ids, labels = anchors["ids"].tolist(), anchors["labels"].tolist()
            asks: dict[int, list] = {}
            for ask in packed["asks"] or ():
                asks.setdefault(ask["place"], []).append(ask)
            for place, score in _scored(shard, anchors):
                other = (shard["labels"] != labels[place]) & (shard["ids"] != ids[place])
                most = np.iinfo(score.dtype).max
                for ask in asks.get(place, ()):
                    low, high = -(-band[0] * ask["score"] // 100), band[1] * ask["score"] // 100
                    if low > high:
                        continue
                    allowed = other & (score >= max(low, -most)) & (score <= min(high, most)) if low <= most else other & False
                    for best in _highest(score, allowed, k):
                        rows.append((packed["dim"], packed["block"], place, ask["nth"], ids[place], ask["vec_id"],
                                     ask["score"], int(shard["ids"][best]), int(score[best])))
        return _table(rows)

    return search


def _first(found: DataFrame, k: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95),
                   every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: int = 256, shift_every: int = 7, labels: int = 10, shard_rows: int = 16384,
                   block_rows: int = 2048) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    Anchors are the rows whose id `every` divides. A score is the inner product with the anchor of the
    components floor(scale * x), kept to +-(2^63 - 1); higher ones come first, ties by smaller id. For
    each anchor and each of its first `positives` other rows of its label come the first `negatives`
    rows of other labels whose score lies between band[0] and band[1] per cent of the positive's.
    Where `shift_every` divides the id, the label is first moved on by one, modulo `labels`.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part; vectors
    are compared with those of their own length, empty ones score 0. A row is no candidate for anchors
    of its own id. Anchors that repeat are answered each time, candidates that repeat count each time.
    Labels are never grouped by, and shards and blocks are dealt evenly whatever ids and labels are.
    """
    rows = stored(whole_vectors(vectors, id_col, vector_col, label_col, scale, shift_every, labels), "labelled")
    asked = rows.where(F.col("vec_id") % every == 0)
    n_shards, n_blocks = parts_for(rows.count(), shard_rows), parts_for(asked.count(), block_rows)
    shards = stored(rows.repartition(n_shards).mapInArrow(_shard, "dim int, shard int, rows binary"), "shards")
    blocks = stored(asked.repartition(n_blocks).mapInArrow(_block, "dim int, block int, anchors binary"), "anchors")
    ask = "array<struct<place:int,nth:int,vec_id:long,score:long>>"

    def searched(blocks: DataFrame, function) -> DataFrame:
        """Every block of the stated anchors meets every shard; a task holds one of each."""
        key = ("dim", "shard", "block")
        lent = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        return lent.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(function, _FOUND_DDL)

    anchor = ("dim", "block", "place")
    first = _first(searched(blocks.withColumn("asks", F.lit(None).cast(ask)), _positives(positives)), positives, *anchor)
    asks = first.groupBy("dim", "block").agg(
        F.collect_list(F.struct("place", F.col("rank").alias("nth"), "vec_id", "score")).cast(ask).alias("asks"))
    known = stored(blocks.join(asks, ["dim", "block"], "left"), "anchors")
    found = _first(searched(known, _negatives(negatives, band)), negatives, *anchor, "nth")
    return found.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
