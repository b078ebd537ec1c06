"""Benchmark decontamination: a prefix-filtered set join with exact containment.

A window is `width` consecutive words of an item (an item of fewer words is one window). A
document holds a window only if it holds all of the window's shingles, so with containment 1
the necessary prefix of a window, its shingles ordered by rarity in the documents, is its
rarest shingle alone. Document positions whose shingle is in the prefix index are candidates;
the length bound (the document has the window's words at all), the positional bound (the
window, laid at the shingle's place, lies inside the document) and the comparison of all words
of the window then decide. No other shingle of a document is looked at then. The benchmark is
taken in blocks of bounded size, files in the shared folder, of which a process holds one.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, filesystem, fresh_path, only, pieces, unused

#: Words are runs of these bytes, lower-cased: digits, a to z, and all that isn't ASCII.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Words of the benchmark in one block; larger benchmarks are taken block by block.
BLOCK_WORDS = 2_000_000


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split()


class Block:
    """Some benchmark items as arrays: their words, the distinct windows with their owners, and the windows' shingles."""

    def __init__(self, items: list[tuple], width: int, shingle: int):
        self.ids: dict[bytes, int] = {}
        self.items: list[str] = []
        flat, starts, sizes, end = [], [], [], 0
        for item, text in items:
            words = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)], dtype=np.int32)
            if len(words):
                n = min(width, len(words))
                starts.append(end + np.arange(len(words) - n + 1))
                sizes.append(np.full(len(starts[-1]), n))
                end += len(words)
                flat.append(words)
                self.items.append(str(item))
        join = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
        owner = np.repeat(np.arange(len(starts)), [len(x) for x in starts])
        self.flat, start, size = join(flat).astype(np.int32), join(starts), join(sizes)
        self.start, self.size, window = [], [], np.empty(len(start), dtype=np.int64)
        for n in np.unique(size).tolist():  # windows of the same words are one
            rows = np.flatnonzero(size == n)
            same = np.ascontiguousarray(self.flat[start[rows][:, None] + np.arange(n)]).view(np.dtype((np.void, 4 * n))).reshape(-1)
            _, first, number = np.unique(same, return_index=True, return_inverse=True)
            window[rows] = number + sum(map(len, self.start))
            self.start.append(start[rows][first])
            self.size.append(np.full(len(first), n))
        self.start, self.size = join(self.start), join(self.size)
        pairs = np.unique(np.stack([window, owner], axis=1), axis=0) if len(window) else np.empty((0, 2), dtype=np.int64)
        self.owners, self.owned = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))
        self.lengths = np.minimum(self.size, shingle)
        self.mix = {k: np.random.default_rng(7).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1) for k in np.unique(self.lengths).tolist()}
        self.hashes, self.offsets, self.count = {}, {}, 0
        for k in self.mix:
            h = self.hash(k, self.flat)
            used = np.zeros(len(h) + 1, dtype=np.int64)
            mine = self.lengths == k
            np.add.at(used, self.start[mine], 1)
            np.add.at(used, self.start[mine] + self.size[mine] - k + 1, -1)
            self.hashes[k] = np.unique(h[np.cumsum(used[:-1]) > 0])
            self.offsets[k] = self.count
            self.count += len(self.hashes[k])

    def hash(self, k: int, ids: np.ndarray) -> np.ndarray:
        """A hash of the k words from each place; equal words have equal hashes, and words are compared later."""
        if len(ids) < k:
            return np.empty(0, dtype=np.uint64)
        x, n = np.zeros(len(ids) - k + 1, dtype=np.uint64), len(ids) - k + 1
        for j, m in enumerate(self.mix[k]):
            x += ids[j : j + n].astype(np.uint64) * m
        return x ^ (x >> np.uint64(29))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Ids of a document's words, 0 for those that no item has."""
        get = self.ids.get
        return np.fromiter([get(w, 0) for w in words], dtype=np.int32, count=len(words))

    def found(self, ids: np.ndarray, tables: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places in the document, places in the table) of shingles that a table of sorted hashes has."""
        for k, known in tables.items():
            if len(ids) < k or not len(known):
                continue
            gaps = np.concatenate(([0], np.cumsum(ids == 0)))
            at = np.flatnonzero(gaps[k:] == gaps[:-k])
            if not len(at):
                continue
            h = self.hash(k, ids)[at]
            i = np.minimum(np.searchsorted(known, h), len(known) - 1)
            ok = known[i] == h
            if ok.any():
                yield k, at[ok], i[ok]

    def choose(self, frequency: np.ndarray) -> None:
        """Put each window under its rarest shingle; the other shingles go."""
        self.prefix: dict[int, np.ndarray] = {}
        self.under: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, known in self.hashes.items():
            number = np.searchsorted(known, self.hash(k, self.flat))
            number = np.minimum(number, max(0, len(known) - 1))
            window, best = [], []
            for n in np.unique(self.size[self.lengths == k]).tolist():
                rows = np.flatnonzero((self.lengths == k) & (self.size == n))
                s = number[self.start[rows][:, None] + np.arange(n - k + 1)]
                order = np.lexsort((s, frequency[s + self.offsets[k]]), axis=1) if n > k else np.zeros((len(rows), 1), dtype=np.int64)
                window.append(rows)
                best.append(order[:, 0])
            window, best = np.concatenate(window), np.concatenate(best)
            own = number[self.start[window] + best]
            order = np.argsort(own, kind="stable")
            own, window, best = own[order], window[order], best[order]
            kept, first = np.unique(own, return_index=True)
            self.prefix[k] = known[kept]
            self.under[k] = np.append(first, len(own)), window, best
        self.hashes = {}

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marks of the hit words, numbers of the items) of one document."""
        marks, owners = np.zeros(len(ids) + 1, dtype=np.int64), []
        for k, at, i in self.found(ids, self.prefix):
            bounds, windows, offsets = self.under[k]
            many = bounds[i + 1] - bounds[i]
            entry = np.repeat(bounds[i + 1] - np.cumsum(many), many) + np.arange(int(many.sum()))
            window = windows[entry]
            first = np.repeat(at, many) - offsets[entry]
            size = self.size[window]
            ok = (first >= 0) & (first + size <= len(ids))  # length and positional bounds
            window, first, size = window[ok], first[ok], size[ok]
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                for s in range(0, len(rows), 1 << 16):
                    r = rows[s : s + (1 << 16)]
                    each = np.arange(n)
                    r = r[(ids[first[r][:, None] + each] == self.flat[self.start[window[r]][:, None] + each]).all(axis=1)]
                    np.add.at(marks, first[r], 1)
                    np.add.at(marks, first[r] + n, -1)
                    owners += [self.owners[self.owned[w] : self.owned[w + 1]] for w in np.unique(window[r]).tolist()]
        return np.cumsum(marks[:-1]) > 0, np.unique(np.concatenate(owners)) if owners else np.empty(0, dtype=np.int64)


_HELD: dict[str, Block] = {}


def loaded(path: str) -> Block:
    """A block of the shared folder; a worker holds one at a time."""
    if path not in _HELD:
        _HELD.clear()
        fs, inner = filesystem(path)
        with fs.open_input_file(inner) as f:
            _HELD[path] = pickle.loads(f.read())
    return _HELD[path]


def stored(block: Block, path: str) -> None:
    fs, inner = filesystem(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner) as f:
        pickle.dump(block, f, protocol=5)


def frequencies(docs: DataFrame, paths: list[str], text_col: str) -> DataFrame:
    """(block, s, n): in how many documents each item shingle occurs, over all documents, for all blocks in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                words = [words_of(raw or b"") for raw in texts]
                for number, path in enumerate(paths):
                    x = loaded(path)
                    total = [np.unique(np.concatenate([i + x.offsets[k] for k, _, i in got])) for w in words if (got := list(x.found(x.numbers(w), x.hashes)))]
                    if total:
                        s, n = np.unique(np.concatenate(total), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), number, dtype=np.int32)), pa.array(s), pa.array(n.astype(np.int64))], names=["block", "s", "n"])

    return cut(docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "block int, s long, n long").groupBy("block", "s").agg(F.sum("n").alias("n")))


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """The benchmark's items in blocks of bounded size, streamed through the driver."""
    block, held = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").orderBy("i", "t")
    for item, text in rows.toLocalIterator():
        block.append((item, text.encode()))
        held += len(words_of(text.encode()))
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def prepared(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, width: int, shingle: int, block_words: int) -> list[str]:
    """The paths of the benchmark's blocks in the shared folder, each with its windows under their rarest shingles. The driver holds one block at a time."""
    folder = fresh_path(docs.sparkSession, "benchmark")
    paths = []
    for items in item_blocks(benchmark, item_col, item_text_col, block_words):
        block = Block(items, width, shingle)
        if block.count:
            paths.append(f"{folder}/{len(paths):06d}.pickle")
            stored(block, paths[-1])
    if paths:
        counted = frequencies(docs, paths, text_col)
        for number, path in enumerate(paths):
            block, fs = loaded(path), counted.where(F.col("block") == number).select("s", "n").toArrow()  # as many rows at most as the block has shingles
            total = np.zeros(block.count, dtype=np.int64)
            total[fs.column("s").to_numpy()] = fs.column("n").to_numpy()
            block.choose(total)
            stored(block, path.replace(".pickle", ".prefix"))
        _HELD.clear()
    return [p.replace(".pickle", ".prefix") for p in paths]


def matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, shingle: int = 5, block_words: int = BLOCK_WORDS, names: tuple[str, str, str] = ("n_words", "hit", "items"), carry: list[str] | None = None) -> DataFrame:
    """docs with columns of the given names: the number of words, the hit word positions, and the items.

    carry: the columns of docs that the result keeps, all by default. The documents are read
    twice, once for the shingles' frequencies and once for the hits, however many blocks the
    benchmark has: a worker takes the blocks one after the other for each of its batches.
    Nothing is shuffled but the shingles' counts.
    """
    kept = docs.columns if carry is None else carry
    paths = prepared(docs, benchmark, text_col, item_col, item_text_col, width, shingle, block_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            counts, found, items = [], [], []
            for _, texts in pieces(batch, text_col):
                words = [words_of(raw or b"") for raw in texts]
                counts += map(len, words)
                marks, owned = [[] for _ in words], [[] for _ in words]
                for path in paths:
                    x = loaded(path)
                    for i, w in enumerate(words):
                        hit, owners = x.hits(x.numbers(w))
                        if len(owners):
                            marks[i].append(np.flatnonzero(hit))
                            owned[i] += [x.items[o] for o in owners.tolist()]
                found += [np.unique(np.concatenate(m)).tolist() if m else [] for m in marks]
                items += [sorted(set(o)) for o in owned]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            made = [pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*cols, *made], names=[*kept, *names])

    added = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.ArrayType(T.IntegerType())), T.StructField(names[2], T.ArrayType(T.StringType()))]
    return docs.mapInArrow(run, T.StructType([*[docs.schema[n] for n in kept], *added]))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, items, hit_words.

    A null or empty text has no word, no hit and the digest of the empty string; a very long
    one is searched whole, in memory in proportion to it. Items whose
    id or text is null, or that have no word, are left out; an item id that is repeated counts
    once in a document. Null and repeated document ids are kept; other columns of both tables
    are ignored whatever their names. An empty benchmark leaves every document clean.
    """
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    m = matches(source, benchmark, "text", carry=["id"], **options)
    return m.select(
        F.col("id").alias(id_col), "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), "items", F.col("hit").alias("hit_words"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that hold no window of the benchmark. Null and empty texts stay, and repeated rows each."""
    names = tuple(unused(docs, n) for n in ("n_words", "hit", "items"))
    return matches(docs, benchmark, text_col, names=names, **options).where(F.size(names[1]) == 0).select(*docs.columns)


def brute(text: str | None, items: list[tuple], width: int = 10) -> tuple:
    """What report() gives for one text, by comparing every window with every position."""
    words = words_of((text or "").encode())
    hit, owners = set(), set()
    for item, body in items:
        own = words_of((body or "").encode())
        n = min(width, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == own[i : i + n]:
                    hit.update(range(p, p + n))
                    owners.add(str(item))
    return len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)
