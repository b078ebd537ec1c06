"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
    return both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = cut(edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("k"), "m"))
    moved = edges.join(least, F.col("b") == F.col("k")).select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y"))
    return moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node reachable; nodes without a link are left out.

    Links are long ids in two columns, in any order and repeated as may be; self-links and
    links with a null are ignored. Each round is two equi-joins whose other side has one row
    per node and is cut from its aggregation, so that the skew-join rule can split a node with
    very many links. Rounds grow with the logarithm of the longest chain. Nothing but a count and a checksum goes to the driver.
    """
    now = cut(edges.where(f"{a} <> {b}").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    seen = _digest(now)
    while seen[0]:
        now = cut(_small_star(_large_star(now)))
        last, seen = seen, _digest(now)
        if last == seen:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
