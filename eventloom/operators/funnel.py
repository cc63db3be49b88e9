"""Ordered three-step funnel per user and window, summed per window.

`viewed`, `clicked` and `purchased` count users who had the step at all; the `completed` columns
count users who reached the step in order of (timestamp, seq).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.timeparts import floor_ms, to_ms

STEPS = ("view", "click", "purchase")
COUNTS = ("viewed", "clicked", "purchased", "completedVC", "completedCP", "completedVCP")

#: Time levels of the streaming fold, and how many summaries of one level the next may join.
LEVELS = ("1 millisecond", "1 second", "1 minute", "1 hour", "1 day")
_FAN_IN = 1000
#: Slots of a window that a user's clicks are summed up in before they are joined.
_SLOTS = 1000


def funnel_stats(df: DataFrame, size: str = "5 minutes", steps: Sequence[str] = STEPS,
                 seq: str = "seq", slice: str = LEVELS[0]) -> DataFrame:
    """Funnel counts per window. `slice` only matters for streams (see `_funnel_stream`).

    The third step needs the second, so `completedCP` always equals `completedVCP`.
    """
    if df.isStreaming:
        return _funnel_stream(df, size, steps, seq, slice)
    return _funnel_batch(df, size, steps, seq)


def _position(seq: str) -> Column:
    """(timestamp, seq) as one ordered number, so that min and max stay in hash aggregation."""
    room = F.lit("1" + "0" * 19).cast("decimal(20,0)")
    return F.col("timestamp").cast("decimal(18,0)") * room + F.col(seq).cast("decimal(19,0)")


def _funnel_batch(df: DataFrame, size: str, steps: Sequence[str], seq: str) -> DataFrame:
    """Constant-size state per user and window; nothing is gathered.

    A click lies between the first view and the last purchase or it does not. The first and last
    click settle that for most users. For the rest the first and last click of every slot, a
    thousandth of the window, are looked at: a hot user brings a thousand rows at most. What is open
    then has view, purchase and clicks around them all in one slot, whose clicks are read again.
    """
    view, click, purchase = (F.col("event") == step for step in steps)
    placed = df.select(
        "userId", floor_ms(F.col("timestamp"), to_ms(size)).alias("ws"), "event",
        F.when(F.col("event").isin(list(steps)), _position(seq)).alias("pos"), "timestamp")
    # The join below implies this filter for one of the two uses of `marks`; stated here it holds
    # for both, and their shuffle is shared.
    placed = placed.filter(F.col("userId").isNotNull() & F.col("ws").isNotNull())
    marks = placed.groupBy("userId", "ws").agg(
        F.min(F.when(view, F.col("pos"))).alias("first_view"),
        F.min(F.when(click, F.col("pos"))).alias("first_click"),
        F.max(F.when(click, F.col("pos"))).alias("last_click"),
        F.max(F.when(purchase, F.col("pos"))).alias("last_purchase"),
    )
    first_view, first_click = F.col("first_view"), F.col("first_click")
    last_click, last_purchase = F.col("last_click"), F.col("last_purchase")
    certain = (
        ((last_click > first_view) & (last_click < last_purchase))
        | ((first_click > first_view) & (first_click < last_purchase))
    )
    possible = (
        (first_view < last_purchase) & (last_click > first_view) & (first_click < last_purchase)
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("bigint")
    settled = marks.select(
        "ws", flag(first_view.isNotNull()).alias("viewed"),
        flag(first_click.isNotNull()).alias("clicked"),
        flag(last_purchase.isNotNull()).alias("purchased"),
        flag(last_click > first_view).alias("vc"), flag(certain).alias("vcp"))

    asked = marks.filter(possible & ~certain).select(
        "userId", "ws", F.col("first_view").alias("lo"), F.col("last_purchase").alias("hi"))
    inside = lambda c: (F.col(c) > F.col("lo")) & (F.col(c) < F.col("hi"))
    slot = F.floor((F.col("timestamp") - F.col("ws")) / F.lit(max(1, to_ms(size) // _SLOTS)))
    clicks = placed.filter(click).withColumn("slot", slot)
    met = (
        clicks.groupBy("userId", "ws", "slot").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
        .join(asked, ["userId", "ws"]).filter((F.col("last") > F.col("lo")) & (F.col("first") < F.col("hi")))
        .withColumn("yes", inside("first") | inside("last"))
    )
    seen = met.filter("yes").select("userId", "ws")
    still = met.filter("NOT yes").select("userId", "ws", "slot", "lo", "hi")
    again = clicks.join(still, ["userId", "ws", "slot"]).filter(inside("pos")).select("userId", "ws")
    none = F.lit(0).cast("bigint")
    answered = (
        seen.unionByName(again).distinct()
        .select("ws", none.alias("viewed"), none.alias("clicked"), none.alias("purchased"),
                none.alias("vc"), (none + 1).alias("vcp"))
    )
    totals = settled.unionByName(answered).groupBy("ws").agg(
        *[F.sum(c).alias(c) for c in ("viewed", "clicked", "purchased", "vc", "vcp")])
    return totals.select(
        F.col("ws").alias("windowStart"), (F.col("ws") + to_ms(size)).alias("windowEnd"),
        "viewed", "clicked", "purchased", F.col("vc").alias("completedVC"),
        F.col("vcp").alias("completedCP"), F.col("vcp").alias("completedVCP"))


def _summary(**flags: Column) -> Column:
    return F.struct(*[flag.alias(name) for name, flag in flags.items()])


_EMPTY = dict.fromkeys(("v", "c", "p", "vc", "cp", "vcp"), False)


def _fold(items: Column, step) -> Column:
    start = _summary(**{name: F.lit(value) for name, value in _EMPTY.items()})
    return F.aggregate(items, start, step)


def _add_event(s: Column, x: Column, steps: Sequence[str]) -> Column:
    view, click, purchase = (x["event"] == step for step in steps)
    return _summary(
        v=s["v"] | view, c=s["c"] | click, p=s["p"] | purchase,
        vc=s["vc"] | (click & s["v"]), cp=s["cp"] | (purchase & s["c"]),
        vcp=s["vcp"] | (purchase & s["vc"]))


def _append(s: Column, t: Column) -> Column:
    """Summary of one stretch of events followed by another."""
    return _summary(
        v=s["v"] | t["v"], c=s["c"] | t["c"], p=s["p"] | t["p"],
        vc=s["vc"] | t["vc"] | (s["v"] & t["c"]), cp=s["cp"] | t["cp"] | (s["c"] & t["p"]),
        vcp=s["vcp"] | t["vcp"] | (s["vc"] & t["p"]) | (s["v"] & t["cp"]))


def _between(slice: str, size: str) -> list[str]:
    """As few levels as take a slice to the window with at most _FAN_IN summaries joined in each."""
    at, whole, out = to_ms(slice), to_ms(size), []
    while whole > at * _FAN_IN:
        fits = [x for x in LEVELS if at < to_ms(x) <= min(at * _FAN_IN, whole - 1)
                and to_ms(x) % at == 0 and whole % to_ms(x) == 0]
        if not fits:
            break
        out.append(max(fits, key=to_ms))
        at = to_ms(out[-1])
    return out


def _funnel_stream(df: DataFrame, size: str, steps: Sequence[str], seq: str,
                   slice: str) -> DataFrame:
    """Events are put in order inside one `slice` only, by default a millisecond, where `seq` decides;
    each slice becomes six flags, and flags are joined level by level up to the window.

    No state row holds more than the events of one user and slice, or 1000 summaries: the seconds of a
    hot user become one row each, and so do the minutes and hours.
    """
    if to_ms(size) % to_ms(slice):
        raise ValueError("size must be a multiple of slice")
    step_event = F.when(F.col("event").isin(list(steps)),
                        F.struct("timestamp", F.col(seq).alias("seq"), "event"))
    part = (
        df.groupBy("userId", F.window("et", slice).alias("w"))
        .agg(F.sort_array(F.collect_list(step_event)).alias("steps"))
        .select("userId", "w", _fold(F.col("steps"), lambda s, x: _add_event(s, x, steps)).alias("s"))
    )
    for level in [*_between(slice, size), size]:
        part = (
            part.groupBy("userId", F.window(F.window_time("w"), level).alias("up"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col("w.start").alias("at"), "s"))).alias("parts"))
            .select("userId", F.col("up").alias("w"),
                    _fold(F.col("parts"), lambda s, x: _append(s, x["s"])).alias("s"))
        )
    users = part
    flags = ("s.v", "s.c", "s.p", "s.vc", "s.vcp", "s.vcp")
    totals = users.groupBy(F.window(F.window_time("w"), size).alias("w3")).agg(
        *[F.sum(F.col(f).cast("bigint")).alias(name) for f, name in zip(flags, COUNTS)])
    return totals.select(
        F.unix_millis("w3.start").alias("windowStart"), F.unix_millis("w3.end").alias("windowEnd"),
        *COUNTS)
