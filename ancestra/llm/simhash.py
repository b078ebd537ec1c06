"""SimHash near-duplicates, linked by BK-trees over shards of equal bands.

Fingerprints within radius r of each other agree on all but r of any r + k disjoint bands.
Every fingerprint goes, for each choice of k of the bands, to the shard of its value on these
bands, so each pair within the radius meets in at least one shard, and a shard with f free
bits holds 2**f different fingerprints at most. Each shard is a BK-tree: a node's children
are keyed by their integer Hamming distance to it, and a query follows only the edges within
the radius of its own distance. A shard tree goes to the shard's queries by shuffle: the
fingerprints of a corpus have no size bound under which all trees could be broadcast.

Documents of a given Jaccard similarity need a wide radius, where bands can't be exact.
similar_classes() therefore takes longer fingerprints of the sets of shingles and shards by
random choices of bits, as many as reach a wanted recall. Its BK-trees only find candidates:
the shingle sets lie in files of the shared folder, and a pair is linked by their exact Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, cut, filesystem, fresh_path, only, pieces, remove_path, unused
from .components import components

#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
SEED = 42


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """The SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space.

    Bit i is set if it is set in over half of the XXH64 values of the shingles, repeats
    included. Fewer words than a shingle has: the whole sequence is one. No word: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    n, k = len(words), min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, total, CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > total).tolist())


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", words_per_shingle: int = 3) -> DataFrame:
    """All columns and the fingerprint, as a signed long in `out`. Map only."""
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x or b"", words_per_shingle) for _, texts in pieces(batch, text_col) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=names)

    return docs.mapInArrow(run, schema)


def bk_links(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of different values within the radius, by a BK-tree.

    A node keeps its first value as pivot and one child for each distance to it. All queries
    of a node go down together: only those whose distance to the pivot is within the radius
    of an edge's key follow this edge. Each pair is found once, from its earlier member.
    """
    values = values.view(np.uint64) if values.dtype == np.int64 else values
    stack = [(np.arange(len(values)), np.arange(len(values)))]
    wide = values.ndim == 2  # a fingerprint is a row of words

    def distance(rows: np.ndarray, pivot: int) -> np.ndarray:
        bits = np.bitwise_count(values[rows] ^ values[pivot]).astype(np.int64)
        return bits.sum(axis=1) if wide else bits

    while stack:
        members, queries = stack.pop()
        pivot = members[0]
        near = distance(queries, pivot)
        hit = queries[(near <= radius) & (queries > pivot)]
        if len(hit):
            yield np.full(len(hit), pivot), hit
        members = members[1:]
        if not len(members):
            continue
        edge = distance(members, pivot)
        order = np.argsort(edge, kind="stable")
        edge, members = edge[order], members[order]
        cuts = np.flatnonzero(np.diff(edge)) + 1
        for key, child in zip(edge[np.concatenate(([0], cuts))].tolist(), np.split(members, cuts), strict=True):
            asked = queries[np.abs(near - key) <= radius]
            asked = asked[asked > child[0]]
            if len(asked):
                stack.append((child, asked))


def bk_pairs(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """All pairs of positions (i < j) within the radius."""
    return sorted({(min(a, b), max(a, b)) for x, y in bk_links(values, radius) for a, b in zip(x.tolist(), y.tolist(), strict=True)})


def _roots(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each position reaches."""
    root = np.arange(n)
    gathered = list(links)
    if not gathered:
        return root
    a, b = (np.concatenate(x) for x in zip(*gathered, strict=True))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bands(radius: int, bits: int = 64, extra: int = 4) -> list[int]:
    """Masks of the band choices: `extra` of radius + extra bands of about equal width."""
    edges = np.linspace(0, bits, radius + extra + 1).round().astype(int).tolist()
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(each, extra)]


def links(prints: DataFrame, radius: int, column: str = "fp") -> DataFrame:
    """Links (a, b) between different fingerprints that span the same components as all pairs within the radius.

    prints: one row per different fingerprint. Within a shard each fingerprint is linked to
    the smallest it reaches there, so links grow in proportion to the fingerprints.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.xxhash64(F.lit(i), F.col(column).bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(bands(radius))])
    sharded = prints.select(F.col(column).alias("fp"), F.explode(keys).alias("shard")).repartition("shard").sortWithinPartitions("shard", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_fp, kept_shard = np.empty(0, np.int64), np.empty(0, np.int64)

        def solve(signed: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
            fp = signed.view(np.uint64)  # of negative integers bitwise_count counts the absolute value
            if len(fp) < 2:
                return
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(fp)]))
            sizes = np.diff(cuts)
            two = cuts[:-1][sizes == 2]  # a tree of one edge
            fits = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
            a, b = [fp[two[fits]]], [fp[two[fits] + 1]]
            for s, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                part = fp[s : s + n]
                root = _roots(n, bk_links(part, radius))
                moved = np.flatnonzero(root != np.arange(n))
                a.append(part[root[moved]])
                b.append(part[moved])
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1), axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            fp = np.concatenate([kept_fp, batch.column(0).to_numpy()])
            shard = np.concatenate([kept_shard, batch.column(1).to_numpy()])
            ends = np.flatnonzero(shard != shard[-1]) if len(shard) else []
            whole = int(ends[-1]) + 1 if len(ends) else 0  # the last shard may go on in the next batch
            yield from solve(fp[:whole], shard[:whole])
            kept_fp, kept_shard = fp[whole:], shard[whole:]
        yield from solve(kept_fp, kept_shard)

    return sharded.mapInArrow(run, "a long, b long")


def classes(fingerprinted: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, root, component_id) of each different fingerprint in columns (id_col, fp).

    root names the fingerprint's component; component_id is the smallest id in the fingerprint's component, null if all are null.
    """
    prints = cut(fingerprinted.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(prints.select("fp"), radius))
    joined = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = cut(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    return joined.select("fp", F.col("root").alias("r")).join(smallest, F.col("r") == F.col("root")).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    Exact copies share a fingerprint and are one node. Null and empty texts have fingerprint
    zero, linked like any other; a very long text is hashed whole, its shingles' bits counted in
    parts. A null id is kept and ignored when the smallest id is sought. Repeated rows each get their row. Other columns are left out whatever their names.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    prints = cut(with_fingerprint(source, "text", "fp", words_per_shingle).select("id", "fp"))
    found = classes(prints, "id", radius).withColumnRenamed("fp", "fp2")
    return prints.join(found, F.col("fp") == F.col("fp2")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


WORDS = 4
BITS = 64 * WORDS
#: Random choices of bits are made so that pairs of exactly the wanted similarity meet, within the radius, with this probability.
RECALL = 0.98
#: A shard of over twice so many fingerprints is cut into blocks of about so many; each two blocks meet in a shard of their own.
BLOCK = 4096
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def shingle_set(text: bytes, words_per_shingle: int = 5) -> np.ndarray:
    """The XXH64 values of a text's shingles (words as for fingerprint()), sorted, each once; empty for no word."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n, k = len(words), min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)], dtype=np.uint64))


def set_bits(h: np.ndarray) -> bytes:
    """The 256-bit SimHash of a set of shingles; zeros for an empty set."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        part = h[at : at + CHUNK, None] * np.array(_MIX, dtype=np.uint64)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xFF51AFD7ED558CCD)
        part ^= part >> np.uint64(29)
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def set_fingerprint(text: bytes, words_per_shingle: int = 5) -> bytes:
    """The 256-bit SimHash of the set of a text's shingles."""
    return set_bits(shingle_set(text, words_per_shingle))


#: Bits of a set's place that name the 8-byte word at which it begins; those above name the file, by its task's attempt.
WORD_BITS = 35


class Sets:
    """Shingle sets by their place in the files of a folder; the last few MB stay in memory."""

    def __init__(self, folder: str, most: int = 8 << 20):
        self.fs, self.top = filesystem(folder)
        self.files, self.kept, self.held, self.most = Cache(256), {}, 0, most

    def get(self, place: int) -> np.ndarray:
        found = self.kept.get(place)
        if found is None:
            task, at = place >> WORD_BITS, 8 * (place & ((1 << WORD_BITS) - 1))
            if task not in self.files:
                self.files.room()
                self.files[task] = self.fs.open_input_file(f"{self.top}/{task}")
            head = self.files[task].read_at(4096, at)
            size = 8 + 8 * int.from_bytes(head[:8], "little")
            whole = head[:size] if size <= len(head) else head + self.files[task].read_at(size - len(head), at + len(head))
            found = np.frombuffer(whole, dtype="<u8")[1:]
            if self.held + found.nbytes > self.most:
                self.kept.clear()
                self.held = 0
            self.kept[place] = found
            self.held += found.nbytes
        return found

    def similar(self, one: int, others: list[int], similarity: float) -> np.ndarray:
        """For each of others whether its Jaccard similarity to one is so high; an empty set is like no other."""
        base, out = self.get(one), np.zeros(len(others), dtype=bool)
        rows, parts, total = [], [], 0
        for i, place in enumerate(others):
            x = self.get(place)
            if 0 < similarity * max(len(x), len(base)) <= min(len(x), len(base)) + 1e-6:
                rows.append(i)
                parts.append(x)
                total += len(x)
            if parts and (total >= 1 << 18 or i == len(others) - 1):
                sizes, every = np.array([len(x) for x in parts]), np.concatenate(parts)
                same = base[np.minimum(np.searchsorted(base, every), len(base) - 1)] == every
                shared = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
                out[rows] = shared / (sizes + len(base) - shared) >= similarity
                rows, parts, total = [], [], 0
        return out


def differing(similarity: float) -> float:
    """The share of bits in which SimHashes differ, on average, of equally large sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_for(similarity: float, bits: int = BITS, deviations: float = 3.0) -> int:
    """The distance within which pairs are candidates: the average at the similarity and so many standard deviations."""
    q = differing(similarity)
    return int(bits * q + deviations * math.sqrt(bits * q * (1 - q)))


def meeting(similarity: float, bits: int, width: int, radius: int) -> np.ndarray:
    """(chance, met) for each distance within the radius: how often a pair of this similarity has it, and how often such a pair agrees on `width` random bits."""
    q, d = differing(similarity), np.arange(radius + 1)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = [math.exp(log(bits, x) + x * math.log(q) + (bits - x) * math.log(1 - q)) for x in d.tolist()]
    met = [math.exp(log(bits - x, width) - log(bits, width)) for x in d.tolist()]
    return np.stack([chance, met])


def choices(count: int, similarity: float, bits: int = BITS, recall: float = RECALL) -> np.ndarray:
    """Random choices of bits, one a row: as many bits as shards of some sixteen fingerprints take, as many rows as the recall takes.

    A pair's distance spreads about its average and is the same for all rows, so the chance that
    a pair at the similarity meets is summed over the distances; the average one alone would
    promise too much. Rows grow with the count to the power log2(1 / share of equal bits), 0.24 at a similarity of 0.8.
    """
    width = max(12, int(math.log2(max(count, 2))) - 4)
    chance, met = meeting(similarity, bits, width, radius_for(similarity))
    rows = 1
    while float((chance * (1 - (1 - met) ** rows)).sum()) < recall:
        rows += 1
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(bits, width, replace=False) for _ in range(rows)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Mixed bits of integers (the end of MurmurHash3)."""
    x = x.astype(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> np.uint64(33)) * np.uint64(factor)
    return x ^ x >> np.uint64(33)


def similar_links(prints: DataFrame, count: int, similarity: float, folder: str) -> DataFrame:
    """Links (a, b) of nodes whose sets are so similar, found among fingerprints within the radius. prints: node (the set's place in the folder), fp (32 bytes).

    A shard's links span what its similar pairs connect: a pair is compared unless its nodes are connected already.

    Shards over twice BLOCK are cut into blocks by the node's hash, and each pair of blocks is a
    shard of its own, so all pairs of a shard meet and no task holds more than two blocks of it. How many
    blocks a shard has comes by a join with its size.
    """
    picked, radius, block = choices(count, similarity), radius_for(similarity), BLOCK

    def shards(batch: pa.RecordBatch) -> np.ndarray:
        powers = 1 << np.arange(picked.shape[1], dtype=np.int64)
        bits = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 8 * WORDS), axis=1, bitorder="little").astype(np.int64)
        return np.stack([bits[:, row] @ powers + (i << 40) for i, row in enumerate(picked)], axis=1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                again = pa.array(np.repeat(np.arange(batch.num_rows), len(picked)))
                yield pa.RecordBatch.from_arrays([pa.array(shards(batch).reshape(-1)), batch.column(0).take(again), batch.column(1).take(again)], names=["shard", "node", "fp"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                yield pa.RecordBatch.from_arrays([pa.array(shards(whole.slice(at, 2048)).reshape(-1))], names=["shard"])

    prints = prints.select("node", "fp")
    sizes = prints.mapInArrow(name, "shard long").groupBy("shard").count().where(F.col("count") > 2 * block)
    sizes.select(F.col("shard").alias("large"), F.ceil(F.col("count") / block).cast("int").alias("parts")).write.parquet(f"{folder}/large")
    large = prints.sparkSession.read.parquet(f"{folder}/large")  # a file, so that Spark knows its size and broadcasts it only below its threshold
    rows = prints.mapInArrow(keyed, "shard long, node long, fp binary").join(large, F.col("shard") == F.col("large"), "left")
    mine, whole = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.col("parts").isNull()
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("mine"))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(others)))
    cell = F.when(whole, F.col("shard")).otherwise(F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other")))
    routed = rows.select(cell.alias("shard"), "node", "fp").repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sets = Sets(folder)

        def compared(node: np.ndarray, fp: np.ndarray, a: list, b: list) -> None:
            label = np.arange(len(node))
            for x, y in bk_links(fp, radius):
                pivot = x[0]
                y = y[label[y] != label[pivot]]
                y = y[sets.similar(int(node[pivot]), node[y].tolist(), similarity)] if len(y) else y
                if len(y):
                    joined, first = np.unique(label[y], return_index=True)
                    a.append(np.full(len(first), node[pivot]))
                    b.append(node[y[first]])
                    label[np.isin(label, joined)] = label[pivot]

        def solve(shard: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]))
            sizes, a, b = np.diff(cuts), [], []
            two = cuts[:-1][sizes == 2]  # a tree of one edge
            fits = two[np.bitwise_count(fp[two] ^ fp[two + 1]).astype(np.int64).sum(axis=1) <= radius]
            fits = np.array([i for i in fits.tolist() if sets.similar(int(node[i]), [int(node[i + 1])], similarity)[0]], dtype=np.int64)
            a.append(node[fits])
            b.append(node[fits + 1])
            for s, n in zip(cuts[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                compared(node[s : s + n], fp[s : s + n], a, b)
            a, b = np.concatenate(a), np.concatenate(b)
            if len(a):
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        def joined() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), fp))
            if sum(len(h[0]) for h in held) < 2 * block:
                continue
            shard, node, fp = joined()
            ends = np.flatnonzero(shard != shard[-1])
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield from solve(shard[:whole], node[:whole], fp[:whole])
            held[:] = [(shard[whole:], node[whole:], fp[whole:])]
        if held:
            yield from solve(*joined())

    return routed.mapInArrow(run, "a long, b long")


def similar_classes(source: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """((id, mark, node), (node, root, component_id)) of a frame (id, text): mark is a hash of the whole text, node one of its shingle set.

    Texts are linked whose shingle sets are at least so similar; texts of equal sets share a
    node. root names the component; component_id is its smallest id, null if all are null, and
    components may share it. The sets lie in the shared folder until the links are found.
    """
    folder = fresh_path(source.sparkSession, "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        task, word, known = TaskContext.get().taskAttemptId(), 0, Cache(100_000)
        with fs.open_output_stream(f"{top}/{task}") as out:
            for batch in batches:
                node, place, fp = [], [], []
                for _, texts in pieces(batch, "text"):
                    for x in texts:
                        h = shingle_set(x or b"", words_per_shingle)
                        data = h.astype("<u8").tobytes()
                        n = xxhash.xxh64_intdigest(data, SEED)
                        if n not in known:
                            known.room()
                            known[n] = task << WORD_BITS | word, set_bits(h)
                            out.write(len(h).to_bytes(8, "little") + data)
                            word += 1 + len(h)
                        node.append(n)
                        place.append(known[n][0])
                        fp.append(known[n][1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(place, pa.int64()), pa.array(fp, pa.binary())], names=schema.names)

    schema = T.StructType([source.schema["id"], *[T.StructField(c, T.LongType()) for c in ("mark", "node", "place")], T.StructField("fp", T.BinaryType())])
    rows = cut(source.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text").mapInArrow(run, schema))
    nodes = cut(rows.groupBy("node", "fp").agg(F.min("id").alias("least"), F.min("place").alias("place")))
    links = similar_links(nodes.select(F.col("place").alias("node"), "fp"), nodes.count(), similarity, folder)
    roots = cut(components(links)).withColumnRenamed("node", "rn")
    remove_path(source.sparkSession, folder)
    known = nodes.join(roots, F.col("place") == F.col("rn"), "left").select("node", "least", F.coalesce("root", "place").alias("root"))
    smallest = cut(known.groupBy(F.col("root").alias("sr")).agg(F.min("least").alias("component_id")))
    return rows.select("id", "mark", "node"), known.join(smallest, F.col("root") == F.col("sr")).select("node", "root", "component_id")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their class of similar texts.

    Of each class the row with the smallest id stays; of repeated rows one stays; ids that are
    null come last. Classes whose smallest ids are equal or null each keep a row. Null and empty texts are one class. A very long
    text's set of shingles is held whole. The documents are shuffled once, by id.
    """
    keep, mark = unused(docs, "keep"), unused(docs, "mark")
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    rows, found = similar_classes(source, similarity, words_per_shingle)
    members = rows.groupBy("id", "mark", "node").count().drop("count").join(found.withColumnRenamed("node", "fn"), F.col("node") == F.col("fn"))
    chosen = members.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", F.col("id").alias(keep)).agg(F.min("mark").alias("kept_mark")).select(F.col(keep), "kept_mark")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    return marked.join(chosen, marked[id_col].eqNullSafe(chosen[keep]) & (marked[mark] == chosen["kept_mark"]), "left_semi").dropDuplicates([id_col, mark]).select(*docs.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component.

    Of each component the row with the smallest id stays; of repeated rows one stays. Ids that
    are null come last.
    """
    mark, keep = unused(docs, "fp"), unused(docs, "keep")
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    prints = cut(with_fingerprint(source, "text", "fp", words_per_shingle).select("id", "fp"))
    found = classes(prints, "id", radius)
    members = prints.groupBy("id", "fp").count().join(found.withColumnRenamed("fp", "fp2"), F.col("fp") == F.col("fp2"))
    chosen = members.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root", F.col("id").alias(keep)).agg(F.min("fp").alias("kept_mark")).select(F.col(keep), "kept_mark")
    marked = with_fingerprint(docs, text_col, mark, words_per_shingle)
    return marked.join(chosen, marked[id_col].eqNullSafe(chosen[keep]) & (marked[mark] == chosen["kept_mark"]), "left_semi").dropDuplicates([id_col, mark]).select(*docs.columns)
