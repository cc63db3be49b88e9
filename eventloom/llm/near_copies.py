"""Near copies by Jaccard similarity of word shingles: every pair at the threshold or above is found.

Shingles are put in one order for all documents, rare ones first. Two sets that are similar enough
share a shingle among the first few of each (n - ceil(least * n) + 1 of n), so only those are
indexed. Pairs that meet in a posting list are held against bit maps of their sets first, which rule
out most that are not similar and none that are, and then compared shingle by shingle. A first round
compares the documents whose SimHash fingerprints the index over byte positions links, and each
document with a few others of its list: those with the fewest rare shingles before it, to which the
copies of one text are nearest, and some drawn by hashes. The second leaves out pairs that are already
in one component, so that a large group of copies does not give all its pairs, and looks at a pair
where its first common shingle is: all that the two share lies behind it in both sets, so copies that
have too many rare shingles of their own do not meet. Its join holds pairs against the maps itself.
Fingerprints alone miss pairs near the threshold; the lists find those.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import parts_for, slices, stored
from eventloom.llm.components import connected_components
from eventloom.llm.simhash import bit_counts, fingerprint_links, shingle_hashes

#: So many documents tell which shingles are frequent, or one of so many where those are more, and so many
#: shingles are held as such. All three set the order only, so they change the cost and never the result.
_SAMPLED, _ONE_IN, _HOT = 1 << 13, 8, 1 << 17
#: Keys that are sent to every executor at most: 64-bit hashes, some 30 MB as a table there.
_SENT = 1 << 20
#: Documents of a list that all others are compared with in the first round, as many by their place in the order
#: and as many by hashes. Several, as one may be a copy that is like few of the others. This too changes the cost only.
_HUBS = 2
#: Bits of a set's map, at least; larger sets have the next power of two, so that long texts are told
#: apart too. A bit tells whether an odd number of shingles falls on it, so that maps differ in no more
#: bits than the sets differ in shingles. The halves of a map, XORed, are the map of half its size.
_MAP_BITS = 1024


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Different shingles of a text as signed hashes; a text without words has one that stands for none."""
    blocks = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(blocks)).view(np.int64) if blocks else np.zeros(1, np.int64)


def bit_map(hashes: np.ndarray) -> np.ndarray:
    bits = max(_MAP_BITS, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount(hashes.view(np.uint64) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set, as a signed number: the bits that more than half of its shingles have."""
    most = 2 * bit_counts(hashes.view(np.uint64), np.array([0, len(hashes)]))[0] > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


def _sets(shingle: int, least: Fraction | None = None, hot: dict[int, int] | None = None):
    """`key`, `n` and the shingles of every text: all, or where `least` is given those to be indexed, the map and
    the fingerprint."""
    frequent = np.array(sorted(hot or ()), np.int64)
    counts = np.array([hot[h] for h in frequent.tolist()] if hot else [], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sizes, held, maps, prints = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingle_set(text or b"", shingle)
                sizes.append(len(found))
                if least is not None:
                    maps.append(bit_map(found))
                    prints.append(fingerprint(found))
                    rank = np.zeros(len(found), np.int64)
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
                        rank = np.where(frequent[at] == found, counts[at], 0)
                    must = -(-least.numerator * len(found) // least.denominator)
                    found = found[np.lexsort((found, rank))][:len(found) - must + 1]
                held.append(found)
            bounds = np.concatenate(([0], np.cumsum([len(h) for h in held]))).astype(np.int32)
            columns = {"key": batch.column(0), "n": pa.array(sizes, pa.int64()),
                       "shingles": pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(held)))}
            if least is not None:
                starts = np.concatenate(([0], np.cumsum([len(m) for m in maps]))).astype(np.int32)
                columns["map"] = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(maps)))
                columns["fp"] = pa.array(prints, pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return run


_SETS_DDL = "key string, n long, shingles array<long>"


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _maps_allow(a: str, b: str, least: Fraction) -> Column:
    """Whether the maps of two sets (structs with `n`, `map`) leave it open that they are similar."""
    p, q = least.numerator, least.denominator
    m, n = F.col(f"{a}.map"), F.col(f"{b}.map")
    # The sizes of similar sets differ by a quarter at most, so one map is twice the other at most.
    half = lambda m, n: F.when(F.size(m) > F.size(n), F.zip_with(
        F.slice(m, 1, F.size(n)), F.slice(m, F.size(n) + 1, F.size(n)), lambda x, y: x.bitwiseXOR(y))).otherwise(m)
    apart = F.aggregate(F.zip_with(half(m, n), half(n, m), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda total, bits: total + bits)
    # Similar sets differ in (1 - least) / (1 + least) of the sum of their sizes at most.
    return apart * (p + q) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (q - p)


def _mapped(pairs: DataFrame, nodes: DataFrame, least: Fraction) -> DataFrame:
    """Of pairs (`a`, `b`) of nodes those whose maps leave it open that they are similar."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.struct("n", "map").alias(f"set_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_maps_allow("set_a", "set_b", least)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """Of pairs (`a`, `b`) of nodes those whose similarity is `least` or more."""
    p, q = least.numerator, least.denominator
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # Written, so that few of them are known as few, and the texts stay where they are.
    asked = stored(nodes.join(ends, "node", "left_semi").select("node", "key"), "near-asked")
    sets = stored(
        _among(texts, asked.select("key")).select("key", "text")
        .mapInArrow(_sets(shingle), _SETS_DDL).dropDuplicates(["key"])
        .join(asked, "key").select("node", "n", "shingles"), "near-sets")
    side = lambda s: sets.select(F.col("node").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "shingles")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return stored(
        both.where(shared * (p + q) >= (F.col("n_a") + F.col("n_b")) * p)
        .select("a", "b"), "near-links")


def _alike(nodes: DataFrame) -> DataFrame:
    """`a`, `b`: nodes to compare as their fingerprints are equal, or joined by the index over byte positions."""
    held = nodes.select("node", "fp")
    least = held.groupBy("fp").agg(F.min("node").alias("first"))
    equal = held.join(least, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    at = lambda s: least.select(F.col("fp").alias(f"fp_{s}"), F.col("first").alias(s))
    linked = fingerprint_links(least.select("fp")).distinct().select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return equal.union(linked.join(at("a"), "fp_a").join(at("b"), "fp_b").select("a", "b")).where("a <> b")


def _unlike_lists(entries: DataFrame, least: Fraction) -> DataFrame:
    """One `shingle` for each posting list that can hold similar nodes; of lists with the same nodes, the first.

    All shingles of a passage are in the same documents, which would meet in each of them. Similar sets are
    found at the first shingle they share, and of lists with the same nodes only the first can hold that; as
    one order holds for all nodes, the sum of places tells which list it is. There, (1 - least) / (1 + least)
    of the smaller set lies before it at most, so lists without a node of which that is true are left out.
    Lists are compared by the number of their nodes and 128 bits of hashes.
    """
    p, q = least.numerator, least.denominator
    seen = entries.groupBy("shingle").agg(
        F.count("*").alias("many"), *(F.bit_xor(F.xxhash64("node", F.lit(h))).alias(f"nodes_{h}") for h in range(2)),
        F.sum("at").alias("places"), F.max(F.col("at") * (p + q) <= F.col("n") * (q - p)).alias("early"))
    return (
        seen.where("many > 1").groupBy("many", "nodes_0", "nodes_1")
        .agg(F.min(F.struct("places", "shingle", "early")).alias("of")).where("of.early").select("of.shingle"))


def _among(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts whose key is among `keys`. Texts stay where they are while the keys, as 64-bit hashes, are
    few enough to go to every executor, which is counted first; else both sides are shuffled."""
    if keys.count() <= _SENT:
        few = F.broadcast(keys.select(F.xxhash64("key").alias("hash")).distinct())
        texts = texts.withColumn("hash", F.xxhash64("key")).join(few, "hash", "left_semi").drop("hash")
        # Another text with the same hash is dropped where its set is joined with its key.
        return texts
    return texts.join(keys, "key", "left_semi")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                least: float = 0.8) -> DataFrame:
    """`id`, `key` (SHA-256 of the text), `component_id` for every different id and text.

    A component holds all texts that can be reached over pairs whose sets of `shingle` words have
    Jaccard similarity `least` or more; its id is the smallest in it. ASCII case and white space do
    not count. A text of fewer words is one shingle; texts without words, null too, are alike. Null
    ids have a component like others, but name one only where it has no other id.
    """
    level = Fraction(least).limit_denominator(1000)
    p, q = level.numerator, level.denominator
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    ids = stored(docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")).distinct(), "near-ids")
    every = min(parts_for(ids.count(), _SAMPLED), _ONE_IN)
    hot = dict(
        texts.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).mapInArrow(_sets(shingle), _SETS_DDL)
        .select(F.explode("shingles").alias("shingle")).groupBy("shingle").count().where("count > 2")
        .orderBy(F.col("count").desc(), "shingle").limit(_HOT).collect())
    nodes = stored(
        texts.mapInArrow(_sets(shingle, level, hot), f"{_SETS_DDL}, map array<long>, fp long").dropDuplicates(["key"])
        .withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    def may(a: str, b: str) -> Column:
        """Whether two rows that share a shingle can be similar: what is before and after it bounds the overlap."""
        col = lambda side, name: F.col(f"{side}.{name}")
        most = (F.least(col(a, "at"), col(b, "at")) + 1
                + F.least(col(a, "n") - col(a, "at"), col(b, "n") - col(b, "at")) - 1)
        return most * (p + q) >= (col(a, "n") + col(b, "n")) * p

    def first_shared(a: str, b: str) -> Column:
        """Whether similar rows can share this shingle as the first: all the overlap is from here on."""
        rest = F.least(*(F.col(f"{side}.n") - F.col(f"{side}.at") for side in (a, b)))
        return rest * (p + q) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * p

    row = F.struct("n", "node", F.col("at").cast("long").alias("at"))
    together = Window.partitionBy("shingle")
    entries = nodes.select("node", "n", F.posexplode("shingles").alias("at", "shingle"))
    drawn = [F.xxhash64("x.node", F.lit(h)) for h in range(2 * _HUBS)]
    order = [F.struct("x.at", d) for d in drawn[:_HUBS]] + drawn[_HUBS:]
    lists = stored(
        entries.join(_unlike_lists(entries, level), "shingle", "left_semi").select("shingle", row.alias("x"))
        .withColumn("hubs", F.array(*(F.min_by("x", o).over(together) for o in order))), "near-lists")
    stars = (
        lists.select("x", F.explode(F.array_distinct("hubs")).alias("hub"))
        .where((F.col("x.node") != F.col("hub.node")) & may("x", "hub")))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    alike = stored(_alike(nodes), "near-alike").select(*pair(F.col("a"), F.col("b")))
    first = stored(stars.select(*pair(F.col("x.node"), F.col("hub.node"))).union(alike).distinct(), "near-pairs")
    links = _verified(stored(_mapped(first, nodes, level), "near-pairs"), nodes, texts, shingle, level)

    # Most rows of a list may be in one component: `main`, whose rows are not held against each other.
    placed = stored(
        lists.select("shingle", "x").join(connected_components(links).withColumnRenamed("node", "of"),
                                          F.col("x.node") == F.col("of"), "left")
        .select("shingle", "x", F.coalesce("root", "x.node").alias("root"))
        .withColumns({"low": F.min("root").over(together), "high": F.max("root").over(together),
                      "main": F.mode("root").over(together)})
        .where("low < high").select("shingle", "x", "root", "main"), "near-lists")
    with_map = (
        placed.join(nodes.select(F.col("node").alias("of"), "map"), F.col("x.node") == F.col("of"))
        .select("shingle", F.struct("x.*", "map").alias("x"), "root", "main"))
    left = with_map.where("root <> main").select("shingle", F.col("x").alias("l"), F.col("root").alias("l_root"))
    right = with_map.select(F.col("shingle").alias("met"), F.col("x").alias("r"), F.col("root").alias("r_root"), "main")
    # The verdict on pairs of the first round is known.
    second = stored(
        left.join(right, (F.col("shingle") == F.col("met"))
                  & ((F.col("r_root") == F.col("main")) | (F.col("l.node") < F.col("r.node")))
                  & (F.col("l_root") != F.col("r_root")) & first_shared("l", "r") & _maps_allow("l", "r", level))
        .select(*pair(F.col("l.node"), F.col("r.node"))).distinct()
        .join(first, ["a", "b"], "left_anti"), "near-pairs")
    links = links.union(_verified(second, nodes, texts, shingle, level))

    roots = connected_components(links).withColumnRenamed("node", "of")
    known = stored(
        ids.join(nodes.select("key", "node"), "key").join(roots, F.col("node") == F.col("of"), "left")
        .select("id", "key", F.coalesce("root", "node").alias("root")), "near-known")
    names = known.groupBy("root").agg(F.min("id").alias("component_id"))
    return known.join(names, "root").select("id", "key", "component_id")
