"""Quantiles per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _width(value: Column) -> Column:
    """How many low bits a coarse slice leaves open: 64 slices per power of two."""
    return F.greatest(F.length(F.bin(value)) - 7, F.lit(0))


def _slice_of(value: Column) -> Column:
    """Order-preserving coarse slice of a non-negative bigint."""
    return _width(value) * 64 + F.call_function("shiftright", value, _width(value))


def _fine_slice_of(value: Column) -> Column:
    """Order-preserving slice that leaves half of a coarse slice's bits open."""
    return F.call_function("shiftright", value, F.floor(_width(value) / 2).cast("int"))


def approx_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str,
                    accuracy: int = 10_000) -> DataFrame:
    """One mergeable sketch per group: a single shuffle whose size does not grow with the rows."""
    return df.groupBy(*keys).agg(F.percentile_approx(value, q, accuracy).alias(out))


def _joined(counts: DataFrame, chosen: DataFrame, keys: Sequence[str], slice_: str) -> DataFrame:
    """The counts that lie in a chosen slice of their group.

    Null-safe throughout: a plain equality would imply a filter on one use of `counts` only, and
    the uses would no longer share their scan and shuffle.
    """
    right = chosen.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)} | {slice_: "_chosen"})
    return counts.join(right, reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
        F.col(slice_).eqNullSafe(F.col("_chosen")))).drop("_chosen", *(f"_k{i}" for i in range(len(keys))))


def _holding(slices: DataFrame, keys: Sequence[str], slice_: str) -> DataFrame:
    """The one or two slices that hold the wanted ranks, and how many rows lie below each."""
    below = F.col("_upto") - F.col("_n")
    return (
        slices.filter((below <= F.col("_high")) & (F.col("_upto") > F.col("_low")))
        .select(*keys, slice_, below.alias("_before"), "_low", "_high", "_part")
    )


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, out: str) -> DataFrame:
    """Linearly interpolated quantile of a non-negative bigint column.

    No group is ever gathered. Equal values are counted first (map-side combine), their counts
    are summed into a bounded number of slices, the one or two slices that hold the wanted ranks are
    cut again into slices of half their bits, and only those that hold the ranks are looked at value
    by value. For values near 2^40 a task orders 2^17 rows of a group at most.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value).agg(F.count("*").alias("_n"))
        .withColumns({"_slice": _slice_of(F.col(value)), "_fine": _fine_slice_of(F.col(value))})
    )
    whole = Window.partitionBy(*keys)
    position = F.col("_total") - 1
    coarse = _holding(
        counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(whole.orderBy("_slice")))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_low", F.floor(position * q))
        .withColumn("_part", position * q - F.col("_low"))
        .withColumn("_high", F.least(F.col("_low") + 1, position)), keys, "_slice")
    ranks = ("_low", "_high", "_part")
    fine = _holding(
        _joined(counts, coarse, keys, "_slice")
        .groupBy(*keys, F.struct("_slice", "_fine").alias("_cut"))
        .agg(F.sum("_n").alias("_n"), F.min("_before").alias("_before"), *[F.first(c).alias(c) for c in ranks])
        .withColumn("_upto", F.sum("_n").over(whole.orderBy("_cut")) + F.min("_before").over(whole)),
        keys, "_cut")
    ranked = (
        _joined(counts.withColumn("_cut", F.struct("_slice", "_fine")), fine, keys, "_cut")
        .withColumn("_seen", F.sum("_n").over(whole.orderBy(value)) + F.min("_before").over(whole))
    )
    at = lambda rank: F.min(F.when(F.col("_seen") > F.col(rank), F.col(value)))
    return (
        ranked.groupBy(*keys)
        .agg(at("_low").alias("_v0"), at("_high").alias("_v1"), F.first("_part").alias("_part"))
        .select(*keys, (F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_part")).alias(out))
    )
