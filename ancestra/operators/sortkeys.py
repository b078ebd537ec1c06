"""Order-preserving integer labels of sort keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.session import cut

from .relational import asof, insert_ignore, numbered, positions

LOWEST, HIGHEST = -(1 << 31), (1 << 31) - 1


def weighted_count(keys: DataFrame, key: str, growing: str, factor: int) -> DataFrame:
    """factor times the keys that begin with `growing`, and the others."""
    return keys.agg(F.sum(F.when(F.col(key).startswith(growing), factor).otherwise(1)).alias("weight"))


def rebuilt(keys: DataFrame, key: str, growing: str, factor: int) -> DataFrame:
    """(key, value): labels of all different keys over the whole range, keys that begin with `growing` with a gap `factor` times the others'."""
    distinct = keys.select(key).distinct()
    weight = weighted_count(distinct, key, growing, factor).first()[0] or 1
    gap = (1 << 32) // (weight + 1)
    label = cut(numbered(distinct, key))
    heavy = cut(numbered(distinct.where(F.col(key).startswith(growing)), key, out="passed"))
    below = asof(label, heavy, key, "passed", out="passed")
    value = F.lit(LOWEST).cast("long") + gap * (F.col("label") + (factor - 1) * F.coalesce("passed", F.lit(0)))
    return below.select(key, value.cast("int").alias("value"))


def midpoint(before, after):
    """Between two labels, toward zero; either may be null for the end of the range."""
    return ((F.coalesce(before, F.lit(LOWEST)).cast("long") + F.coalesce(after, F.lit(HIGHEST)).cast("long")) / 2).cast("long").cast("int")


def inserted(labels: DataFrame, keys: DataFrame, key: str = "sort_key") -> DataFrame:
    """labels with the keys it hasn't, each halfway between its neighbours; where several fall between the same two, they share out the gap evenly in their order.

    Where a gap is too small for its keys, the labels of the smallest aligned ranges that are at most half full are shared
    out anew with them; labels elsewhere stay. So labels keep the strict order of their keys.
    """
    labels = cut(labels.select(key, "value"))
    new = cut(keys.select(key).distinct().join(labels.select(key), key, "left_anti"))
    new = cut(asof(new, labels, key, "value", how="backward", out="low"))
    new = cut(asof(new, labels, key, "value", how="forward", out="high"))
    many = new.groupBy(F.col("low").alias("of_low"), F.col("high").alias("of_high")).agg(F.count(F.lit(1)).alias("n"))
    new = positions(new, [key], by=["low", "high"], out="at").join(many, F.col("low").eqNullSafe(F.col("of_low")) & F.col("high").eqNullSafe(F.col("of_high")))
    low, high = F.coalesce("low", F.lit(LOWEST)).cast("long"), F.coalesce("high", F.lit(HIGHEST)).cast("long")
    at, n = F.col("at"), F.col("n")
    crowded = new.where(n > high - low - 1).select(low.alias("near"))
    if crowded.first() is not None:
        moved = shared_out(labels, new.select(key, low.alias("near")), crowded, key)
        rest = labels.join(moved.select(key), key, "left_anti").unionByName(moved)
        return inserted(rest, new.select(key).join(moved.select(key), key, "left_anti"), key)
    step = ((low * (n + 1 - at) + high * at) / (n + 1)).cast("long")
    value = F.when(n == 1, midpoint(F.col("low"), F.col("high"))).otherwise(step.cast("int"))
    return insert_ignore(labels.select(key, "value"), new.select(key, value.alias("value")), key)


def shared_out(labels: DataFrame, new: DataFrame, crowded: DataFrame, key: str) -> DataFrame:
    """(key, value): new labels of all keys, old and new, in the ranges round the crowded places; new keys are where the label before them is (near)."""
    every = cut(labels.select(key, F.col("value").cast("long").alias("near")).unionByName(new))
    crowded = cut(crowded.distinct())
    for i in range(1, 33):
        block = lambda c, i=i: F.floor((F.col(c) - LOWEST) / (1 << i)).cast("long").alias("block")
        inside = every.select(key, block("near")).join(crowded.select(block("near")).distinct(), "block", "left_semi")
        counts = inside.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        if counts.where(F.col("n") > 1 << (i - 1)).first() is None:
            inside = positions(cut(inside), [key], by=["block"], out="at").join(counts, "block")
            value = F.lit(LOWEST).cast("long") + F.col("block") * (1 << i) + F.floor(F.col("at") * F.lit(1 << i).cast("long") / (F.col("n") + 1)).cast("long")
            return cut(inside.select(key, value.cast("int").alias("value")))
    raise ValueError("more keys than half of all labels")
