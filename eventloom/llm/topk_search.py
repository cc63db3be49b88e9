"""Exact top-k inner product search with one KD-tree per shard.

Rows are dealt to shards by the upper median splits, found on a bounded sample, and each shard splits
its vectors further at the median of the widest dimension down to small leaves. Every node has the tight
box of its vectors; the inner product of a query with anything in a box is bounded by the sum of the
larger products with the box's sides. Nodes are visited best bound first, until no bound reaches the
query's k-th score. A first round looks into the shards of a query's own part only; the k-th score found
there is handed on. The second round holds it against the boxes of all shards, and sends a query only
where the bound reaches that score.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import parts_for, stored

_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """`vec_id`, `v`: floor(scale * x) of every component; vectors with holes take no part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # Doubles from 2^53 on are whole already, and would not fit the long that floor gives.
    floor = lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)
    scaled = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x * float(scale))
    return (
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))
        .where(F.col("v").isNotNull() & F.col("vec_id").isNotNull() & finite)
        .select("vec_id", F.transform("v", floor).alias("v"))
    )


def _saved(**arrays: np.ndarray) -> bytes:
    """Arrays as bytes; whole doubles take the smallest type that holds them."""
    for name, x in arrays.items():
        if x.dtype == float:
            most = np.abs(x).max(initial=0)
            arrays[name] = x.astype(np.int16 if most < 1 << 15 else np.int32) if most < 1 << 31 else x
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loaded(data: bytes, *points: str) -> dict[str, np.ndarray]:
    arrays = dict(np.load(io.BytesIO(data)))
    return arrays | {n: arrays[n].astype(float) for n in points}


def build_tree(ids: np.ndarray, points: np.ndarray, leaf: int) -> dict[str, np.ndarray]:
    """Nodes in the order they are made, children together; rows of a node lie next to each other."""
    order = np.argsort(ids, kind="stable")
    nodes, todo = [], [(0, len(ids))]
    for start, end in todo:
        rows = points[order[start:end]]
        low, high = rows.min(axis=0), rows.max(axis=0)
        child = -1
        if end - start > leaf:
            # Empty vectors have no widest dimension; like other equal points they are split as they lie.
            wide = int(np.argmax(high - low)) if points.shape[1] else None
            middle = (end - start) // 2
            if wide is not None and high[wide] > low[wide]:
                order[start:end] = order[start:end][np.argpartition(rows[:, wide], middle)]
            child = len(todo)
            todo += [(start, start + middle), (start + middle, end)]
        nodes.append((start, end, child, ids[order[start:end]].min(), low, high))
    columns = list(zip(*nodes))
    return {
        "ids": ids[order], "points": points[order], "start": np.array(columns[0]), "end": np.array(columns[1]),
        "child": np.array(columns[2]), "least": np.array(columns[3]), "low": np.array(columns[4]), "high": np.array(columns[5]),
    }


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b without rounding: as doubles where every partial sum fits, else as whole numbers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        whole = lambda x: np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
        return whole(a) @ whole(b)
    return a @ b


def search_tree(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int,
                floors: list, leaves: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(query, vec_id, score) of the best k per query; fewer where `floors` rules more out.

    `floors` is a score per query that k vectors are known to reach. `leaves` stops after so many.
    """
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _products(tree["high"], positive.T) + _products(tree["low"], negative.T)
    start, end, child, least = (tree[n].tolist() for n in ("start", "end", "child", "least"))
    for q, own in enumerate(ids.tolist()):
        bound, floor = bounds[:, q], floors[q]
        best: list[tuple] = []          # (score, -vec_id), the worst first
        heap, seen = [(-bound[0], 0)], 0
        while heap:
            top, node = heapq.heappop(heap)
            top = -top
            if floor is not None and top < floor:
                break
            if len(best) == k:
                if top < best[0][0]:
                    break
                if top == best[0][0] and least[node] > -best[0][1]:
                    continue
            if child[node] >= 0:
                for c in (child[node], child[node] + 1):
                    heapq.heappush(heap, (-bound[c], c))
                continue
            scores = _products(tree["points"][start[node]:end[node]], queries[q][:, None])[:, 0]
            if scores.dtype == object:
                scores = np.array([max(-_LONG - 1, min(_LONG, x)) for x in scores], object)
            near = np.flatnonzero(tree["ids"][start[node]:end[node]] != own)
            if len(best) == k:
                near = near[scores[near] >= best[0][0]]
            elif len(near) > 4 * k:
                # The k best are among them, with all rows tied with the last.
                close = scores[near].astype(float)
                near = near[close >= np.partition(close, len(near) - k)[len(near) - k]]
            for i in near.tolist():
                entry = (int(scores[i]), -int(tree["ids"][start[node] + i]))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            seen += 1
            if leaves is not None and seen >= leaves:
                break
        for score, vec in best:
            if floor is None or score >= floor:
                yield q, -vec, score


#: Values of the sample that the upper splits are found on, sampled rows a part, blocks of a task, and
#: boxes that are looked at together.
_SAMPLED, _PER_PART, _LANE, _BOXES = 1 << 22, 32, 16, 4096


def upper_splits(sample: np.ndarray, parts: int) -> dict[str, np.ndarray]:
    """Median splits of the widest dimension into about `parts` parts, numbered from left to right.

    A node has an `axis` (-1: it is a part), the `value` from which rows go right, and its children.
    """
    nodes: list[list] = []
    count = 0

    def cut(rows: np.ndarray, wanted: int) -> int:
        nonlocal count
        here, low, high = len(nodes), rows.min(axis=0), rows.max(axis=0)
        nodes.append([-1, 0.0, 0, 0, 0])
        if wanted > 1 and len(rows) > 1 and rows.shape[1]:
            axis = int(np.argmax(high - low))
            value = float(np.partition(rows[:, axis], len(rows) // 2)[len(rows) // 2])
            left = rows[:, axis] < value
            if left.any():
                nodes[here][:2] = axis, value
                nodes[here][2] = cut(rows[left], wanted // 2)
                nodes[here][3] = cut(rows[~left], wanted - wanted // 2)
                return here
        nodes[here][4] = count
        count += 1
        return here

    cut(sample, parts)
    axis, value, left, right, part = zip(*nodes)
    return {"axis": np.array(axis), "value": np.array(value), "left": np.array(left), "right": np.array(right),
            "part": np.array(part)}


def part_of(splits: dict[str, np.ndarray], points: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    while True:
        inner = np.flatnonzero(splits["axis"][node] >= 0)
        if not len(inner):
            return splits["part"][node]
        at = node[inner]
        right = points[inner, splits["axis"][at]] >= splits["value"][at]
        node[inner] = np.where(right, splits["right"][at], splits["left"][at])


def _points(rows: np.ndarray, bounds: np.ndarray, flat: np.ndarray, dim: int) -> np.ndarray:
    return flat[bounds[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _place(splits: dict[int, dict[str, np.ndarray]]):
    """`part` of every row, and its `turn` among the rows of its part in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            bounds, flat = _lists(batch.column(1))
            sizes = np.diff(bounds)
            part, turn = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                if dim in splits:
                    part[rows] = part_of(splits[dim], _points(rows, bounds, flat, dim))
                for p in np.unique(part[rows]).tolist():
                    own = rows[part[rows] == p]
                    turn[own] = seen.get((dim, p), 0) + np.arange(len(own))
                    seen[dim, p] = int(turn[own[-1]]) + 1
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column(0), "v": batch.column(1), "dim": pa.array(sizes, pa.int32()),
                "part": pa.array(part), "turn": pa.array(turn)})

    return run


def _dealt(placed: DataFrame, most: int, name: str) -> DataFrame:
    """A number `name` for every row, so that about `most` rows of one part share it; rows that are alike
    in everything are dealt out too."""
    slots = placed.groupBy("dim", "part").agg(F.ceil(F.count("*") / most).alias("slots"))
    return placed.join(slots, ["dim", "part"]).withColumn(
        name, F.shiftleft(F.col("part"), 31) + F.col("turn") % F.col("slots")).drop("slots", "turn")


def _tree(leaf: int):
    def build(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        column = table["v"].combine_chunks()
        points = _points(np.arange(table.num_rows), *_lists(column), dim)
        tree = build_tree(table["vec_id"].to_numpy(), points, leaf)
        box = lambda side: pa.array([tree[side][0].tolist()], pa.list_(pa.float64()))
        return pa.table({"dim": table["dim"][:1], "part": table["part"][:1], "shard": table["shard"][:1], "low": box("low"),
                         "high": box("high"), "tree": pa.array([_saved(**tree)], pa.binary())})

    return build


def _block_of(table: pa.Table) -> pa.Table:
    """The queries of a block as one row; a query is named by its place in the block."""
    dim = table["dim"][0].as_py()
    points = _points(np.arange(table.num_rows), *_lists(table["v"].combine_chunks()), dim)
    packed = _saved(ids=table["vec_id"].to_numpy(), points=points)
    return pa.table({"dim": table["dim"][:1], "part": table["part"][:1], "block": table["block"][:1],
                     "queries": pa.array([packed], pa.binary())})


def _reached(boxes: pa.Table, blocks: pa.Table) -> pa.Table:
    """Which queries of which block can have one of their best in a shard, by the shard's box."""
    rows: list[tuple] = []
    if boxes.num_rows:
        low, high = (np.array(boxes[side].to_pylist(), float).reshape(boxes.num_rows, boxes["dim"][0].as_py()) for side in ("low", "high"))
        shards = boxes["shard"].to_pylist()
        for block in blocks.to_pylist():
            queries = _loaded(block["queries"], "points")["points"]
            bounds = _products(high, np.maximum(queries, 0).T) + _products(low, np.minimum(queries, 0).T)
            floors = np.full(len(queries), -np.inf, bounds.dtype)
            for known in block["floors"] or ():
                floors[known["place"]] = known["score"]
            open_ = bounds >= floors
            for i in np.flatnonzero(open_.any(axis=1)).tolist():
                rows.append((block["dim"], block["block"], shards[i], np.flatnonzero(open_[i]).astype("<i4").tobytes()))
    dim, block, shard, places = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"dim": pa.array(dim, pa.int32()), "block": pa.array(block, pa.int64()),
                     "shard": pa.array(shard, pa.int64()), "places": pa.array(places, pa.binary())})


_FOUND = [("dim", pa.int32()), ("block", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()),
          ("vec_id", pa.int64()), ("score", pa.int64())]
_FOUND_DDL = "dim int, block long, place int, query_id long, vec_id long, score long"


def _searcher(k: int, leaves: int | None):
    """Blocks of queries that come to a tree; `places` names the queries of a block that do (null: all)."""
    def search(trees: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = []
        if trees.num_rows and blocks.num_rows:
            tree = _loaded(trees["tree"][0].as_py(), "points", "low", "high")
            for block in blocks.to_pylist():
                queries = _loaded(block["queries"], "points")
                every = np.arange(len(queries["ids"]))
                places = every if block["places"] is None else np.frombuffer(block["places"], "<i4")
                floors: list = [None] * len(every)
                for known in block["floors"] or ():
                    floors[known["place"]] = known["score"]
                ids, named = queries["ids"][places], places.tolist()
                own = ids.tolist()
                rows += [(block["dim"], block["block"], named[q], own[q], vec, score) for q, vec, score in search_tree(
                    tree, ids, queries["points"][places], k, [floors[p] for p in named], leaves)]
        columns = list(zip(*rows)) or [()] * len(_FOUND)
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FOUND)], [n for n, _ in _FOUND])

    return search


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best per query; rows that cannot be among them are dropped before the shuffle."""
    order = Window.partitionBy("dim", "block", "place").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _splits_of(rows: DataFrame, shard_rows: int) -> dict[int, dict[str, np.ndarray]]:
    """Upper splits per length of vector, from a sample of _SAMPLED values at most (in the mean), by a
    hash of the ids. They say where rows go and never what is found; a length that the sample has not
    seen is one part."""
    total = rows.agg(F.count("*").alias("n"), F.sum(F.size("v")).alias("values")).first()
    every = max(1, -(-(total["values"] or 0) // _SAMPLED))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("v").toArrow()
    bounds, flat = _lists(sample["v"].combine_chunks()) if sample.num_rows else (np.zeros(1, np.int64), np.zeros(0))
    sizes = np.diff(bounds)
    out = {}
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        parts = min(parts_for(len(own) * every, shard_rows), max(1, len(own) // _PER_PART))
        out[dim] = upper_splits(_points(own, bounds, flat, dim), parts)
    return out


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: int = 1024, shard_rows: int = 16384, leaf: int = 256,
          block_rows: int = 2048) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the k best for every row whose id `every` divides.

    Score is the inner product of the vectors with components floor(scale * x), kept to the range of
    a long before it is ranked; ties go to the smaller id. Vectors that are null, have a null id, or hold null or
    non-finite components take no part; vectors are compared with those of their own length. A row is
    no candidate for queries of its own id. A query row that repeats is answered each time, and a
    candidate that repeats counts each time; rows that are alike are dealt to different shards and blocks.
    """
    rows = stored(quantised(vectors, id_col, vector_col, scale), "vectors")
    return _best(_searched(rows, k, every, shard_rows, leaf, block_rows)[0], k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(rows: DataFrame, k: int, every: int, shard_rows: int, leaf: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(what the second round found, which block went to which shard in it)."""
    placed = stored(rows.mapInArrow(
        _place(_splits_of(rows, shard_rows)), "vec_id long, v array<double>, dim int, part long, turn long"), "placed")
    trees = stored(
        _dealt(placed, shard_rows, "shard").groupBy("dim", "part", "shard").applyInArrow(
            _tree(leaf), "dim int, part long, shard long, low array<double>, high array<double>, tree binary"), "trees")
    blocks = stored(
        _dealt(placed.where(F.col("vec_id") % every == 0), block_rows, "block").groupBy("dim", "part", "block").applyInArrow(
            _block_of, "dim int, part long, block long, queries binary"), "queries")
    lanes, chunks = parts_for(blocks.count(), _LANE), parts_for(trees.count(), _BOXES)
    lane = F.pmod(F.xxhash64("dim", "block"), F.lit(lanes)).alias("lane")

    def searched(sent: DataFrame, leaves: int | None) -> DataFrame:
        """Some blocks at a time come to a tree; the tree is there once for each lane of them."""
        sent = sent.withColumn("lane", lane)
        key = ("dim", "shard", "lane")
        lent = trees.select("dim", "shard", "tree").join(sent.select(*key).distinct(), ["dim", "shard"])
        lent = lent.select("tree", *(F.col(c).alias(c) for c in key))        # columns of its own, not of `sent`
        return lent.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_searcher(k, leaves), _FOUND_DDL)

    nothing = [F.lit(None).cast("array<struct<place:int,score:long>>").alias("floors"), F.lit(None).cast("binary").alias("places")]
    near = blocks.join(trees.select("dim", "part", "shard"), ["dim", "part"]).select("dim", "shard", "block", "queries", *nothing)
    first = _best(searched(near, 2), k).where(F.col("rank") == k)
    floors = first.groupBy("dim", "block").agg(F.collect_list(F.struct("place", "score")).alias("floors"))
    known = stored(blocks.drop("part").join(floors, ["dim", "block"], "left"), "queries")

    chunk = F.pmod(F.xxhash64("dim", "shard"), F.lit(chunks))
    boxes = trees.select("dim", "shard", "low", "high", chunk.alias("chunk")).withColumn(
        "lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    asking = known.withColumn("lane", lane).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    key = ("dim", "lane", "chunk")
    reached = stored(
        boxes.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(_reached, "dim int, block long, shard long, places binary"),
        "reached")
    return searched(reached.join(known, ["dim", "block"]), None), reached
