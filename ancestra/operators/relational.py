"""As-of joins, keyed merges, hierarchies and running buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ancestra.session import cut


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return out


def placed(df: DataFrame, *order: str) -> DataFrame:
    """df cut, with __b, the number of its rows' range in an order: as many ranges as the session has shuffle partitions, about equal in rows. Equal rows share a range."""
    return cut(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()))


def positions(df: DataFrame, order: list[str], by: list[str] | None = None, out: str = "position") -> DataFrame:
    """df with each row's place, from 1, in an order, within the rows that agree in the `by` columns.

    Places are counted in ranges of the order, and a range adds the rows of those before it, from
    one row each; no task sees all rows of a large group.
    """
    by = by or []
    local = placed(df, *by, *order)
    sizes = local.groupBy(*by, "__b").count()
    earlier = F.sum("count").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # one row a range of a group
    sizes = sizes.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__b").alias("__q"), F.coalesce(earlier, F.lit(0)).alias("__before"))
    ranked = local.withColumn("__r", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)))
    return ranked.join(sizes, _same(by) & (F.col("__b") == F.col("__q"))).withColumn(out, F.col("__before") + F.col("__r")).select(*df.columns, out)


def asof(left: DataFrame, right: DataFrame, key: str, value: str, by: list[str] | None = None, how: str = "backward", out: str = "found") -> DataFrame:
    """left with the `value` of the right row whose key is nearest: at or before ("backward"), after ("forward") or at or after ("forward_inclusive").

    Both sides have the key column and the `by` columns; of right rows with equal keys the
    smallest value counts. Rows of both are put in one order and each takes the last (or next)
    right row, without pairs. The order is cut into ranges that are ordered on their own, and
    what a range of a group passes on to its next comes from one summary row, so that neither
    all rows nor a large group go through one task. Rows with a null key find nothing.
    """
    by = by or []
    forward = how != "backward"
    right = right.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min(value).alias("__v"))
    # a left row must come after an equal right row to see it backward, and before it forward
    left_rank = {"backward": 1, "forward": 1, "forward_inclusive": 0}[how]
    right_rank = {"backward": 0, "forward": 0, "forward_inclusive": 1}[how]
    a = left.withColumns({"__v": F.lit(None).cast(right.schema["__v"].dataType), "__k": F.col(key), "__s": F.lit(left_rank), "__l": F.lit(True)})
    b = right.select(*by, F.col(key).alias("__k"), "__v", F.lit(right_rank).alias("__s"), F.lit(False).alias("__l"))
    rows = a.unionByName(b, allowMissingColumns=True)
    order = [F.desc("__k"), F.desc("__s")] if forward else [F.col("__k"), F.col("__s")]
    local = placed(rows.where(F.col("__k").isNotNull()), "__k")
    local = local.withColumn("__b", -F.col("__b")) if forward else local
    inner = local.withColumn("__o", F.last("__v", ignorenulls=True).over(Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    pick = F.min_by if forward else F.max_by
    ends = local.where("not __l").groupBy(*by, "__b").agg(pick("__v", "__k").alias("__e"))
    steps = local.select(*by, "__b").distinct().join(ends.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__b").alias("__f"), "__e"), _same(by) & (F.col("__b") == F.col("__f")), "left")
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # one row a range of a group
    carry = steps.withColumn("__c", F.last("__e", ignorenulls=True).over(before)).select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__b").alias("__i"), "__c")
    found = inner.join(carry, _same(by) & (F.col("__b") == F.col("__i")), "left").withColumn(out, F.coalesce("__o", "__c"))
    found = found.unionByName(rows.where(F.col("__k").isNull()), allowMissingColumns=True)
    return found.where("__l").select(*left.columns, out)


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with rows of the same key replaced by those of changes, and new ones added."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_by_key(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti")


def insert_ignore(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target with the rows whose key it hasn't."""
    return target.unionByName(rows.dropDuplicates([key]).join(target.select(key), key, "left_anti"))


def update_from(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """target with `column` from the source row of the same key, where there is one."""
    new = source.select(F.col(key).alias("__k"), F.col(column).alias("__n"), F.lit(True).alias("__h"))
    return target.join(new, F.col(key) == F.col("__k"), "left").withColumn(column, F.when(F.col("__h"), F.col("__n")).otherwise(F.col(column))).select(*target.columns)


def resolve_redirects(df: DataFrame, redirects: DataFrame, column: str, out: str) -> DataFrame:
    """df with the target of the column's redirect, or the column itself."""
    r = redirects.select(F.col("source").alias("__s"), F.col("target").alias("__t"))
    return df.join(r, F.col(column) == F.col("__s"), "left").withColumn(out, F.coalesce("__t", F.col(column))).select(*df.columns, out)


def latest_by(df: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """(key, value): the value of the highest version of each key."""
    return df.groupBy(key).agg(F.max_by(value, version).alias(value))


def numbered(df: DataFrame, key: str, start: int = 0, gap: int = 1, out: str = "label") -> DataFrame:
    """df with start + gap * row number in the order of a key."""
    return positions(df, [key], out="__n").withColumn(out, F.lit(start).cast("long") + F.col("__n") * gap).select(*df.columns, out)


def bucket_effect(weights: np.ndarray, interval: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What rows of these weights make of a sum that is held before them: (sums, ends, total).

    With h held, the first row whose sum here reaches interval - h begins anew: the first of `sums`
    that does, and `ends` of it is what is then held after the last row; if none does, h + total is.
    """
    total = np.cumsum(weights)
    n = len(total)
    following = np.maximum(np.searchsorted(total, total + interval), np.arange(n) + 1).tolist()
    last, ends = int(total[-1]), [0] * n
    for i in range(n - 1, -1, -1):
        ends[i] = ends[following[i]] if following[i] < n else last - int(total[i])
    first = np.flatnonzero(np.diff(total, prepend=-1) > 0)  # the first row of each sum
    first = first[: int(np.searchsorted(total[first], interval)) + 1]
    return total[first], np.array(ends, dtype=np.int64)[first], last


def bucket_after(held: int, sums: np.ndarray, ends: np.ndarray, total: int, interval: int) -> int:
    at = int(np.searchsorted(sums, interval - held))
    return int(ends[at]) if at < len(sums) else held + total


def running_buckets(df: DataFrame, group: str, order: str, weight: str, interval: int) -> DataFrame:
    """(group, order, total): the rows at which the weights summed since the last such row reach the interval; the sum then begins anew.

    The reset makes it a fold along a group's order, but not one task a group: rows lie in ranges of (group, order).
    Of each range the effect of its first and its last group's rows, on any sum that may be held before them, is found
    apart; these effects, two a range, are composed along each group and say with what sum each range begins, and then all
    ranges are folded at once. Weights are whole numbers of at least 0 (null: 0), the interval at least 1.
    """
    if interval < 1:
        raise ValueError("the interval must be at least 1")
    kinds = dict(df.dtypes)
    rows = placed(df.select(group, order, F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias(weight)), group, order)
    rows = rows.sortWithinPartitions("__b", group, order)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, object, int, pa.RecordBatch]]:
        """(whether it goes on with the run before, group, range, rows) of rows that are together in group and range."""
        last = None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True))
            start = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start]:
                    yield keys[start] == last, *keys[start], batch.slice(start, i - start)
                    last, start = keys[start], i

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now, at, firsts = None, None, set()

        def made(final: bool) -> Iterator[pa.RecordBatch]:
            if held and (at not in firsts or final):
                firsts.add(at)
                sums, ends, total = bucket_effect(np.concatenate(held), interval)
                yield pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([at], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([total], pa.int64())], names=["g", "b", "sums", "ends", "total"])

        kind = None
        for goes_on, g, b, part in runs(batches):
            kind = part.schema.field(0).type
            w = part.column(2).to_numpy()
            if len(w) and w.min() < 0:
                raise ValueError("weights must be at least 0")
            if not goes_on:
                yield from made(b != at)
                held = []
            now, at = g, b
            held.append(w)
        yield from made(True)

    found = rows.mapInArrow(effects, f"g {kinds[group]}, b int, sums array<long>, ends array<long>, total long")

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        held, out = 0, []
        for x in frame.sort_values("b").itertuples(index=False):
            out.append((x.g, x.b, held))
            held = bucket_after(held, np.array(x.sums, dtype=np.int64), np.array(x.ends, dtype=np.int64), x.total, interval)
        return pd.DataFrame({"g": frame["g"].iloc[[0] * len(out)].to_numpy(), "b": [x[1] for x in out], "held": [x[2] for x in out]})

    begun = found.groupBy("g").applyInPandas(composed, f"g {kinds[group]}, b int, held long").where("held > 0").collect()  # one row a range at most, as only a range's first group goes on from before
    start = {r["b"]: r["held"] for r in begun}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = 0, set()
        for goes_on, _, b, part in runs(batches):
            if not goes_on:
                held = 0 if b in seen else start.get(b, 0)
                seen.add(b)
            picked, totals = [], []
            for i, w in enumerate(part.column(2).to_pylist()):
                held += w
                if held >= interval:
                    picked.append(i)
                    totals.append(held)
                    held = 0
            if picked:
                kept = part.take(pa.array(picked))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(totals, pa.int64())], names=[group, order, "total"])

    return rows.mapInArrow(fold, f"`{group}` {kinds[group]}, `{order}` {kinds[order]}, total long")


def variants_merged(current: DataFrame, adds: Column, deletes: Column) -> DataFrame:
    """(name, confirmed, computer) after adds and deletes: confirmed gains adds and loses deletes, computer loses both; both sorted."""
    return current.withColumns({"confirmed": F.array_sort(F.array_except(F.array_union("confirmed", adds), deletes)), "computer": F.array_sort(F.array_except(F.array_except("computer", adds), deletes))})
