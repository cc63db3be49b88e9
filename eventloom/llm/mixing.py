"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source is due the same number of copies, target / size of the source. Whole
copies are certain; the fraction is rounded by pairing documents: mass (size x fraction) moves from
one to the other, at random and with the right odds, until one of them is at 0 or 1. Mass is
conserved in every step, so a source misses its target by less than its last document. Documents are
reduced in groups, the one unsettled document of each group goes to the next level of the tree, and
a level has a `fan`-th of the rows of the level below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, stored, uniform

WEIGHTS = (3, 1, 2)
_SETTLED = 1e-9


def word_count(text: Column) -> Column:
    """Words are runs of anything but ASCII white space; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """`source`, `source_size`, `target`: `share` of all sizes, dealt by weight, capped at `most`.

    Weights repeat over the sources in code point order, null last. What capped sources cannot take
    goes to the others by weight. That comes to one level for all that are not capped, and filling
    the sources in the order of cap / weight finds it in one pass. The rows here are one per source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*map(F.lit, weights))
    weighed = sizes.withColumn("weight", F.get(cycle, (place % len(weights)).cast("int"))).withColumn(
        "cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = weighed.withColumns({
        "capped_below": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "total": F.sum("source_size").over(whole) * F.lit(share),
    }).withColumn("level", (F.col("total") - F.col("capped_below")) / F.col("weight_left"))
    fits = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    return filled.withColumn("level", F.first(fits, ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).select("source", "source_size",
             F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _fold(items: Column, seed: int, level: int) -> Column:
    """Settle a list of (key, mass, part) one after the other; what is open at the end is `open`."""
    item = "struct<key:string,mass:double,part:double>"
    start = F.struct(F.lit(None).cast(item).alias("open"),
                     F.array().cast("array<struct<key:string,copy:int>>").alias("done"))

    def settled(row: Column, copy: Column) -> Column:
        return F.array(F.struct(row["key"].alias("key"), copy.cast("int").alias("copy")))

    def step(state: Column, new: Column) -> Column:
        old = state["open"]
        # `up`: mass that the old one can still take from the new one; `down`: the reverse.
        up = F.least((1 - old["part"]) * old["mass"], new["part"] * new["mass"])
        down = F.least(old["part"] * old["mass"], (1 - new["part"]) * new["mass"])
        draw = uniform(F.lit(seed), F.lit(level), old["key"], new["key"])
        move = F.when(draw < down / (up + down), up).otherwise(-down)
        a, b = old["part"] + move / old["mass"], new["part"] - move / new["mass"]
        pair = F.struct(a.alias("a"), b.alias("b"))
        # Of the two, the one nearer to 0 or 1 is the one that has arrived there.
        return F.transform(F.array(pair), lambda p: F.when(
            F.least(p["a"], 1 - p["a"]) <= F.least(p["b"], 1 - p["b"]),
            F.struct(F.struct(new["key"].alias("key"), new["mass"].alias("mass"), p["b"].alias("part")).alias("open"),
                     F.concat(state["done"], settled(old, F.round(p["a"]))).alias("done")),
        ).otherwise(
            F.struct(F.struct(old["key"].alias("key"), old["mass"].alias("mass"), p["a"].alias("part")).alias("open"),
                     F.concat(state["done"], settled(new, F.round(p["b"]))).alias("done")),
        ))[0]

    def merge(state: Column, new: Column) -> Column:
        whole = F.least(new["part"], 1 - new["part"]) <= _SETTLED
        alone = F.struct(state["open"].alias("open"),
                         F.concat(state["done"], settled(new, F.round(new["part"]))).alias("done"))
        first = F.struct(new.alias("open"), state["done"].alias("done"))
        return F.when(whole, alone).when(state["open"].isNull(), first).when(
            F.least(state["open"]["part"], 1 - state["open"]["part"]) <= _SETTLED,
            F.struct(new.alias("open"), F.concat(
                state["done"], settled(state["open"], F.round(state["open"]["part"]))).alias("done")),
        ).otherwise(step(state, new))

    return F.aggregate(items, start, merge)


def pivotal_rounding(items: DataFrame, seed: int = 17, fan: int = 64) -> DataFrame:
    """`source`, `key`, `copy` (0 or 1) for rows (`source`, `key`, `mass` > 0, `part` in [0, 1]).

    `key` is text and names one row of its source. Every level is written, so that the next one does
    not repeat it; the number of levels is the logarithm of the rows to the base `fan`.
    """
    counts = stored(items.groupBy("source").agg(F.count("*").alias("n")), "mix-counts")
    level, done, top = 0, [], counts.agg(F.max("n")).first()[0] or 0
    while True:
        groups = F.ceil(F.col("n") / fan)
        dealt = items.join(counts.withColumnRenamed("source", "counted"),
                           F.col("source").eqNullSafe(F.col("counted"))).drop("counted")
        folded = stored(
            dealt.groupBy("source", F.pmod(F.xxhash64("key", F.lit(seed + level)), groups).alias("group"))
            .agg(F.sort_array(F.collect_list(F.struct("key", "mass", "part"))).alias("items"))
            .select("source", _fold(F.col("items"), seed, level).alias("state")), f"mix-{level}")
        done.append(folded.select("source", F.explode("state.done").alias("d")).select("source", "d.*"))
        left = folded.where(F.col("state.open").isNotNull()).select("source", "state.open.*")
        if top <= fan:
            break
        level, items = level + 1, left
        counts = stored(left.groupBy("source").agg(F.count("*").alias("n")), "mix-counts")
        top = counts.agg(F.max("n")).first()[0] or 0
    # At the root one row of a source may be left with a fraction; it is drawn alone.
    root = left.select("source", "key", (uniform(F.lit(seed), F.col("key")) < F.col("part")).cast("int").alias("copy"))
    for table in done:
        root = root.unionByName(table)
    return root


def _same(id_: Column, source: Column, size: Column) -> Column:
    """A text that rows share where id, source and size are alike, nulls too."""
    return F.to_json(F.struct(id_.alias("id"), source.alias("source"), size.alias("size")))


def _rank(rows: DataFrame) -> DataFrame:
    """`nth`, from 0, of each row among those that share `same`; rows have a `uid` of their task.

    Rows are counted per task of the table first, so that no task orders more than came from one.
    """
    task = F.shiftright("uid", 33)
    counted = rows.groupBy("same", task.alias("task")).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("same").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("same", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("same", "task").orderBy("uid")
    return rows.withColumn("task", task).withColumn("inner", F.row_number().over(inner) - 1).join(
        bases, ["same", "task"]).withColumn("nth", F.col("base") + F.col("inner")).drop("task", "inner", "base")


def mix_plan(sized: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """`same`, `whole`, `more`: of the rows that share an id, source and size, `more` are taken once
    oftener than `whole` times. Which of them does not matter to the mix.

    Of n such rows with the fraction p of a copy each, floor(n p) copies are certain; only what is left
    of n p is drawn, as one row of that size among all others of the source.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.concat_ws("/", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.col("size").cast("string"))
    due = F.col("rows") * (ratio - F.floor(ratio))
    entries = stored(
        sized.where(F.col("size") > 0).groupBy("id", "source", "size", "same").agg(F.count("*").alias("rows"))
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select("same", "source", key.alias("key"), F.col("size").cast("double").alias("mass"), F.floor(ratio).alias("whole"),
                F.floor(due).alias("sure"), (due - F.floor(due)).alias("part")), "mix-entries")
    drawn = pivotal_rounding(entries.select("source", "key", "mass", "part"), seed).select(
        F.col("source").alias("drawn_of"), F.col("key").alias("drawn"), "copy")
    return stored(entries.join(
        drawn, (F.col("key") == F.col("drawn")) & F.col("source").eqNullSafe(F.col("drawn_of")), "left"
    ).select("same", "whole", (F.col("sure") + F.coalesce("copy", F.lit(0))).alias("more")), "mix-plan")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                seed: int = 17) -> DataFrame:
    """`id`, `source`, `size`, `source_size`, `target`, `copies`, `taken` for every row.

    Sizes are words (null text: 0; long texts count whole). Rows without words are not drawn and take 0
    words. A null id or source is a value of its own. Rows that repeat an id, source and size are taken
    as often together as their share of the target asks for, up to one of them. Draws hang on id, source
    and size alone, so reruns agree; of repeated rows the first by task and place in it come first.
    """
    sized = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.monotonically_increasing_id().alias("uid"),
    ).withColumn("same", _same(F.col("id"), F.col("source"), F.col("size"))), "mix-sizes")
    targets = stored(source_targets(sized, weights, share, most), "mix-targets")
    plan = mix_plan(sized, targets, seed)
    copies = F.col("whole") + (F.col("nth") < F.col("more")).cast("long")
    return (
        _rank(sized).join(plan, "same", "left")
        .join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .withColumn("copies", F.coalesce(copies, F.lit(0)).cast("long"))
        .select("id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                    seed: int = 17, row: str = "row", copy: str = "copy") -> DataFrame:
    """`row` (all columns of a document) and `copy`, from 1, as often as the mix takes it."""
    sized = docs.select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("told"),
    ).withColumn("same", _same(F.col("id"), F.col("source"), F.col("size")))
    lean = stored(sized.drop("row"), "mix-sizes")
    targets = stored(source_targets(lean, weights, share, most), "mix-targets")
    plan = mix_plan(lean, targets, seed)
    # Rows that repeat an id, source and size are told apart by their texts; equal ones are alike.
    numbered = sized.select("row", "same", (F.row_number().over(
        Window.partitionBy("same").orderBy("told")) - 1).alias("nth"))
    copies = F.col("whole") + (F.col("nth") < F.col("more")).cast("long")
    return (
        numbered.join(plan, "same").withColumn("copies", copies).where("copies > 0")
        .select(F.col("row").alias(row), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias(copy))
    )
