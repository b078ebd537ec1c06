"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors of a label (and dimension) are ordered lexicographically by concatenated
random hashes, the signs of random projections, and compared with their neighbours in a window of
this order: the run of vectors whose first digits agree. The digits are as many as windows of
about BLOCK vectors take at the label's size, and the passes as many as the wanted recall takes
with so many digits; a label of up to BLOCK vectors is one window and takes one pass. A window is
never cut short: one over twice BLOCK, where copies lie close, is split into blocks, and every
two blocks meet in a task of their own. Pairs that meet are verified by their exact cosine, and
the links of all passes are united. A pass counts a link only if the two weren't in one window
of an earlier pass, which each vector tells by itself: link counts need no table of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import components
from .simhash import _roots, mixed

#: Vectors of a window or a block, about.
BLOCK = 2048
#: A link of just the least cosine shares no window in any pass with this probability, at most.
MISSED = 1e-4
#: Digits of a key, at most.
BITS = 40
#: Rows of a block compared at a time.
ROWS = 512
SEED = 11


def usable(vector: Column, label: Column) -> Column:
    """Whether a row can link: label and vector present, no component null or not finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def schedule(count: int, least: float, block: int = BLOCK, missed: float = MISSED) -> tuple[int, int]:
    """(digits, passes) for so many vectors of a space: windows of about `block` vectors, and passes until a link of the least cosine is missed with the given probability."""
    digits = min(BITS, max(0, math.ceil(math.log2(max(1, count) / block))))
    met = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** digits
    return digits, 1 if met >= 1 else math.ceil(math.log(missed) / math.log1p(-met))


def planes(dim: int, passes: int, digits: int, seed: int = SEED) -> np.ndarray:
    """Random directions of whole numbers, (dim, passes * digits); the same wherever they are made."""
    return np.clip(np.rint(np.random.default_rng([seed, dim, digits]).standard_normal((passes, digits, dim)) * 256), -2047, 2047).reshape(passes * digits, dim).T


def keys(x: np.ndarray, passes: int, digits: int) -> np.ndarray:
    """(rows, passes) keys: the signs of the projections as the digits of an integer, first most significant.

    Vectors are rounded to 20 bits of their largest component, so that all sums are exact and signs the same in every task.
    """
    if not digits:
        return np.zeros((len(x), passes), dtype=np.int64)
    whole = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * (1 << 20))
    signs = (whole @ planes(x.shape[1], passes, digits) >= 0).reshape(len(x), passes, digits)
    return (signs * (1 << np.arange(digits - 1, -1, -1, dtype=np.int64))).sum(axis=2)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _list(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def same_shape(dims: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(dimension, count, rows) of the rows that share both."""
    for dim, count in np.unique(np.stack([dims, counts], axis=1), axis=0).tolist():
        yield dim, count, np.flatnonzero((dims == dim) & (counts == count))


def windows(nodes: DataFrame, least: float, block: int, missed: float, carry: list[str]) -> DataFrame:
    """(cell, pass, *carry) of each vector in each pass; cell names the window. nodes: space, v, n (vectors of the space), and carry."""
    fields = [nodes.schema[c] for c in carry]
    names = ["cell", "pass", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                space, v, n = (batch.column(batch.schema.get_field_index(c)) for c in ("space", "v", "n"))
                for _, count, rows in same_shape(np.diff(v.offsets.to_numpy()), n.to_numpy()):
                    digits, passes = schedule(count, least, block, missed)
                    k = keys(_matrix(v.take(pa.array(rows))), passes, digits)
                    for p in range(passes):
                        cell = mixed(mixed(space.to_numpy()[rows] * 1024 + p) ^ k[:, p].astype(np.uint64)).view(np.int64)
                        at = pa.array(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(rows), p, dtype=np.int32)), *[batch.column(batch.schema.get_field_index(c)).take(at) for c in carry]], names=names)

    columns = list(dict.fromkeys(["space", "v", "n", *carry]))
    return nodes.select(*columns).mapInArrow(run, T.StructType([T.StructField("cell", T.LongType()), T.StructField("pass", T.IntegerType()), *fields]))


def routed(nodes: DataFrame, least: float, block: int, missed: float) -> DataFrame:
    """(g, side, pass, node, space, n, copies, v): windows as groups g; of a large window each pair of blocks is a group, with a side for each block, and each block one of its own."""
    sizes = cut(windows(nodes, least, block, missed, []).groupBy("cell").count().where(F.col("count") > 2 * block).select(F.col("cell").alias("large"), F.ceil(F.col("count") / block).cast("int").alias("parts")))
    rows = windows(nodes, least, block, missed, ["node", "space", "n", "copies", "v"]).join(sizes, F.col("cell") == F.col("large"), "left")
    mine = F.pmod(F.xxhash64("node", "pass"), F.col("parts")).cast("int")
    each = rows.withColumn("mine", mine).withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    g = F.when(F.col("parts").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")))
    side = F.when(F.col("mine").isNull() | (F.col("mine") == F.col("other")), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return each.select(g.alias("g"), side.cast("int").alias("side"), "pass", "node", "space", "n", "copies", "v")


def compare(x: np.ndarray, key: np.ndarray, at: int, side: np.ndarray, copies: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a group's vectors x (of length 1) in pass `at`: (further copies linked to each, and star links as places a, b). key: their keys in all passes."""
    gained, whole = np.zeros(len(x), dtype=np.int64), int(side[0]) == 0
    left, right = (np.arange(len(x)),) * 2 if whole else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    root = np.arange(len(x))
    for s in range(0, len(left), ROWS):
        part = left[s : s + ROWS]
        i, j = np.nonzero(x[part] @ x[right].T >= least)
        i, j = part[i], right[j]
        if whole:
            i, j = i[i < j], j[i < j]
        ok = key[i, at] == key[j, at]
        i, j = i[ok], j[ok]
        fresh = ~(key[i, :at] == key[j, :at]).any(axis=1)
        np.add.at(gained, i[fresh], copies[j[fresh]])
        np.add.at(gained, j[fresh], copies[i[fresh]])
        apart = root[i] != root[j]
        if apart.any():
            links = np.unique(np.stack([root[i[apart]], root[j[apart]]], axis=1), axis=0)
            root = _roots(len(x), iter([(links[:, 0], links[:, 1])]))[root]
    moved = np.flatnonzero(root != np.arange(len(x)))
    return gained, root[moved], moved


def linked(nodes: DataFrame, least: float, block: int, missed: float) -> tuple[DataFrame, DataFrame]:
    """((node, n), (a, b)): linked copies and star links of all passes. nodes: node, space, v, copies, n; different vectors."""
    sent = routed(nodes, least, block, missed).repartition("g").sortWithinPartitions("g", "pass", "space")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            g, space, at = (t.column(c).to_numpy() for c in ("g", "space", "pass"))
            edges = np.concatenate(([0], np.flatnonzero((np.diff(g) != 0) | (np.diff(space) != 0) | (np.diff(at) != 0)) + 1, [len(g)])).tolist()
            for s, e in zip(edges, edges[1:], strict=False):
                if e - s < 2:
                    continue
                part = t.slice(s, e - s)
                vectors = _list(part.column("v"))
                side, node, n, copies = (part.column(c).to_numpy() for c in ("side", "node", "n", "copies"))
                for _, count, rows in same_shape(np.diff(vectors.offsets.to_numpy()), n):
                    digits, passes = schedule(count, least, block, missed)
                    x = _matrix(vectors.take(pa.array(rows)))
                    key = keys(x, passes, digits)
                    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    own = node[rows]
                    gained, a, b = compare(x, key, int(at[s]), side[rows], copies[rows], least)
                    hit, nothing = np.flatnonzero(gained), np.zeros(len(a), dtype=np.int64)
                    if len(hit) or len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([own[hit], own[a]])), pa.array(np.concatenate([own[hit], own[b]])), pa.array(np.concatenate([gained[hit], nothing]))], names=["a", "b", "n"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([rest, now]) if rest is not None else now
            g = now.column("g").to_numpy()
            ends = np.flatnonzero(g != g[-1]) if len(g) else []
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield from solve(now.slice(0, whole))
            rest = now.slice(whole)
        if rest is not None and rest.num_rows:
            yield from solve(rest)

    found = cut(sent.mapInArrow(run, "a long, b long, n long"))
    return found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), found.where("a <> b").select("a", "b")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, block: int = BLOCK, missed: float = MISSED) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link if their labels are equal and the cosine, in double precision, is at least
    `least`. Equal vectors of a label are compared as one and each counted. Rows with a null
    id, label or vector, a zero vector, or null or non-finite components link with nothing,
    nor do vectors of different dimensions: n_links 0, component_id the own id, kept true.
    Repeated rows count as vectors of their own with one id. Other columns are left out.
    Every link of two vectors that share a window in any pass is found, however many there are;
    one of the least cosine is missed with the probability `missed` at most, a closer one more
    rarely, and in a space of up to `block` different vectors none is.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "array<double>"
    source = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast(kind).alias("v"), vectors[label_col].alias("label"))
    fine = usable(F.col("v"), F.col("label")) & F.col("id").isNotNull()
    node = F.when(fine, F.xxhash64("label", "v"))
    marked = source.select("id", node.alias("node"), F.xxhash64("label", F.size("v")).alias("space"), "v")
    nodes = cut(marked.where("node is not null").groupBy("node", "space", "v").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies")))
    sizes = nodes.groupBy(F.col("space").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    counts, edges = linked(nodes.join(sizes, F.col("space") == F.col("of")).drop("of"), least, block, missed)
    roots = components(edges).select(F.col("node").alias("rn"), "root")
    known = nodes.select("node", "least_id", "copies").join(counts.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left").join(roots, F.col("node") == F.col("rn"), "left")
    known = known.select(F.col("node").alias("kn"), "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    smallest = cut(known.groupBy(F.col("root").alias("sr")).agg(F.min("least_id").alias("component")))
    known = known.join(smallest, F.col("root") == F.col("sr")).select("kn", "n_links", "component")
    out = marked.select("id", "node").join(known, F.col("node") == F.col("kn"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
