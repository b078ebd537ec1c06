"""Language-model scoring with an Elias-Fano n-gram trie.

The trie's first level holds the words (their 64-bit hashes) with their counts, its second all
bigrams, its third all trigrams; each is a monotone Elias-Fano sequence, as are the pointers
from an n-gram to its successors. Nothing is pruned. A level is cut into shards by ranges, each
a file in the folder that driver and executors share, which workers map into memory. An n-gram
is found by a successor search among its context's words, relative to the context. Nothing of
the model passes through the driver but the shards' sizes.

P(w) is the add-one unigram probability. With the counts c of the training texts,
P(w | v) = (c(v, w) + m * P(w)) / (c(v) + m), and P(w | u, v) = (c(u, v, w) + m3 * P(w | v)) / (c(u, v) + m3);
a context that wasn't seen leaves the shorter one's. The second level keeps P(w | v) and
m3 / (c(v, w) + m3) of each bigram, the third c(u, v, w) / (c(u, v) + m3), in 8 bits each.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, filesystem
from .eliasfano import U64, EliasFano, to_bytes

#: Hash of the token that ends each text; no word has this one on purpose, as words hold no white space.
END = xxhash.xxh64_intdigest(b"\n")
#: Weights of the unigram's probability after a word (m), and of the bigram's after two (m3).
PRIOR, PRIOR3 = 500.0, 5.0
#: Quantised logarithms: 256 steps of [LOWEST, 0].
LOWEST = -12.75
#: Bytes of text taken at a time.
SLICE = 4 << 20
#: Keys gathered before they are merged.
GATHERED = 2 << 20
#: Word ids are packed in 32 bits.
MOST_WORDS = (1 << 32) - 2
#: Bytes of shards that a worker holds of a store that can't be mapped.
HELD = 256 << 20


def held_out(doc_id) -> bool:
    """Whether a document is kept from training: crc32 of its id as text, modulo 7, is 2. A null id's text is empty."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint((log10 - LOWEST) / -LOWEST * 255), 0, 255).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / 255 * -LOWEST + LOWEST


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, index of each token in them, tokens of each text).

    A-Z lower-cased, words between ASCII white space, then END after each text.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    filled = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)[filled]
    coded = pc.dictionary_encode(words.filter(pa.array(filled)))
    digest = xxhash.xxh64_intdigest
    known = np.array([digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()] + [END], dtype=U64)
    counts = np.bincount(doc, minlength=len(sizes)) + 1
    index = np.full(counts.sum(), len(known) - 1, dtype=np.int64)
    ends = np.cumsum(counts) - 1
    inner = np.ones(len(index), dtype=bool)
    inner[ends] = False
    index[inner] = coded.indices.to_numpy(zero_copy_only=False)
    return known, index, counts


def slices(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of a batch in parts of bounded size; null texts are empty."""
    texts = pc.fill_null(batch.column(1), "")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + SLICE, side="right")))
        yield batch.column(0).slice(start, stop - start).to_pylist(), texts.slice(start, stop - start)
        start = stop


class Sums:
    """Sums by key, merged now and then, so that memory follows the different keys of a bounded number of rows."""

    def __init__(self):
        self.parts, self.held = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.empty(0, U64), np.empty(0, np.int64))
        self.parts, self.held = [], 0
        return merged(keys, counts)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[first], np.add.reduceat(counts, first)


_MAPPED: dict[str, np.ndarray] = {}


def mapped(path: str) -> np.ndarray:
    """The bytes of a file of the shared folder, mapped into memory. Of a store that can't be mapped files are read, and the last HELD bytes kept."""
    if path not in _MAPPED:
        store, inner = filesystem(path)
        if store.type_name == "local":
            with open(inner, "rb") as f:
                _MAPPED[path] = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype=np.uint8)
        else:
            with store.open_input_file(inner) as f:
                data = np.frombuffer(f.read(), dtype=np.uint8)
            if sum(x.nbytes for x in _MAPPED.values()) + data.nbytes > HELD:
                _MAPPED.clear()
            _MAPPED[path] = data
    return _MAPPED[path]


def written(path: str, parts: list[np.ndarray]) -> None:
    """Write a shard under a hidden name and rename it, so that a repeated task replaces its own file."""
    import uuid

    store, inner = filesystem(path)
    folder, _, name = inner.rpartition("/")
    store.create_dir(folder, recursive=True)
    hidden = f"{folder}/_{uuid.uuid4().hex}"
    with store.open_output_stream(hidden, compression=None) as f:
        f.write(to_bytes(parts))
    store.move(hidden, inner)


BLOB = "shard int, n int, data binary"


def blob(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit integers, of equal length, compressed: their bytes by significance, so that those that vary little lie together."""
    raw = b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unblob(data: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * n * columns, asbytes=True), dtype=np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(c.T).reshape(-1).view("<u8") for c in raw]


def blobs(shard: np.ndarray, key: np.ndarray, *others: np.ndarray, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """One row for each shard's part of rows sorted by (shard, key), keys as differences."""
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])).tolist()
    parts = [(a, min(e, a + most)) for s, e in zip(cuts, cuts[1:], strict=False) for a in range(s, e, most)]
    if parts:
        data = [blob([np.diff(key[s:e], prepend=U64(0)), *[o[s:e] for o in others]]) for s, e in parts]
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[s]) for s, _ in parts], pa.int32()), pa.array([e - s for s, e in parts], pa.int32()), pa.array(data, pa.binary())], names=["shard", "n", "data"])


def shard_runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """(shard, its parts' columns) of the blobs of a partition; a partition's shards are few and each is whole."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for shard, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key, *others = unblob(data, n, columns)
            held.setdefault(shard, []).append([np.cumsum(key, dtype=U64), *others])
    for shard in sorted(held):
        yield shard, held.pop(shard)


def ordered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order of rows by (a, b)."""
    if not len(a):
        return np.empty(0, dtype=np.int64)
    low = a.min()
    wide = int(b.max()).bit_length()
    if int(a.max() - low).bit_length() + wide <= 64:  # both fit in one key
        return np.argsort(((a - low) << U64(wide)) | b)
    return np.lexsort((b, a))


class Words:
    """The first level: hash to id and count. bits: the hash's leading bits that name its shard."""

    def __init__(self, folder: str, bits: int, sizes: dict[int, tuple[int, int]]):
        self.folder, self.bits = folder, bits
        self.starts, self.before, at, total = {}, {}, 0, 0
        for shard in sorted(sizes):
            self.starts[shard], self.before[shard] = at, total
            at += sizes[shard][0]
            total += sizes[shard][1]
        self.sizes, self.distinct, self.total = sizes, at, total

    def _open(self, shard: int) -> tuple[EliasFano, EliasFano]:
        data = mapped(f"{self.folder}/words-{shard:06d}.bin")
        hashes, at = EliasFano.view(data, 0)
        return hashes, EliasFano.view(data, at)[0]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, tokens of all words with smaller ids) of each hash."""
        ids, counts, before = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        order = np.argsort(hashes)
        shards = (hashes[order] >> U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), dtype=np.int64)
        for shard in np.unique(shards).tolist():
            if shard not in self.sizes:
                continue
            rows = order[np.searchsorted(shards, shard) : np.searchsorted(shards, shard, side="right")]
            ef, sums = self._open(shard)
            at = ef.find(hashes[rows] & U64((1 << (64 - self.bits)) - 1))
            rows, at = rows[at >= 0], at[at >= 0]
            low, high = sums[at].astype(np.int64), sums[at + 1].astype(np.int64)
            ids[rows], counts[rows], before[rows] = at + self.starts[shard], high - low, low + self.before[shard]
        return ids, counts, before


def write_words(folder: str, bits: int, shard: int, hashes: np.ndarray, counts: np.ndarray) -> tuple:
    """Write a shard of the first level; its manifest row (shard, words, tokens)."""
    sums = np.concatenate(([0], np.cumsum(counts))).astype(U64)
    inner = hashes & U64((1 << (64 - bits)) - 1)
    written(f"{folder}/words-{shard:06d}.bin", [*EliasFano.build(inner, 1 << (64 - bits)).arrays(), *EliasFano.build(sums, int(sums[-1]) + 1).arrays()])
    return shard, len(hashes), int(counts.sum())


def codes_of(share: np.ndarray) -> np.ndarray:
    return quantised(np.log10(share))


class Grams:
    """The second and third levels. An n-gram's place is estimated from its first word's first token and its second word's id; a shard holds a range of places, so that a frequent context spreads over several, with all trigrams of its bigrams."""

    def __init__(self, folder: str, words: Words, texts: int, shards: int, prior: float, prior3: float):
        if words.distinct > MOST_WORDS:
            raise ValueError(f"{words.distinct} words, {MOST_WORDS} at most")
        self.folder, self.words, self.texts, self.prior, self.prior3 = folder, words, texts, prior, prior3
        self.per = max(1, -(-(words.total + texts) // shards))
        self.count = (words.total + texts) // self.per + 1
        self.sizes: set[int] = set()

    def place(self, before: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The shard of each bigram; grows with (context, word). before + count * word // distinct, in parts that don't overflow."""
        d = U64(max(1, self.words.distinct))
        c, w = count.astype(U64), word.astype(U64)
        return ((before.astype(U64) + c // d * w + c % d * w // d) // U64(self.per)).astype(np.int64)

    def build(self, shard: int, parts: list[list[np.ndarray]], counts_of: Callable) -> tuple:
        """Write a shard; its manifest row (shard, bigrams, trigrams). parts: (context << 32 | word, next word + 1 or 0 for none, count)."""
        a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = ordered(a, b)
        a, b, n = a[order], b[order], n[order].astype(np.int64)
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        at = np.flatnonzero(first)
        n, a, b = np.add.reduceat(n, at), a[at], b[at]
        start = np.concatenate(([True], a[1:] != a[:-1]))
        at = np.flatnonzero(start)
        total, pair = np.add.reduceat(n, at), a[at]  # a bigram is followed by a word, or by nothing where it ends a text
        of = np.cumsum(start) - 1
        three = b > 0
        of, word3, n3 = of[three], b[three] - U64(1), n[three]
        context, word = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
        lowest, d = int(context[0]), self.words.distinct + 1
        contexts = int(context[-1]) - lowest + 1
        seen = np.bincount(context - lowest, minlength=contexts)
        known = np.flatnonzero(seen)
        own = np.zeros(contexts, dtype=np.int64)
        own[known] = counts_of(known + lowest)
        unigram = (counts_of(word) + 1) / (self.words.total + self.words.distinct + 1)
        chance = (total + self.prior * unigram) / (own[context - lowest] + self.prior)
        head = np.array([lowest, contexts, len(pair), len(n3)], dtype=U64)
        pointers = np.concatenate(([0], np.cumsum(seen))).astype(U64)
        second = EliasFano.build((context - lowest).astype(U64) * U64(d) + word.astype(U64), contexts * d)
        below = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(pair))))).astype(U64)
        third = EliasFano.build(of.astype(U64) * U64(d) + word3, len(pair) * d)
        parts = [head, *EliasFano.build(pointers, len(pair) + 1).arrays(), *second.arrays(), *EliasFano.build(below, len(n3) + 1).arrays(), *third.arrays()]
        written(f"{self.folder}/grams-{shard:06d}.bin", [*parts, codes_of(chance), codes_of(self.prior3 / (total + self.prior3)), codes_of(n3 / (total[of] + self.prior3))])
        return shard, len(pair), len(n3)

    def open(self, shard: int) -> tuple:
        """(first context, contexts, pointers, second level, pointers, third level, the codes of both)."""
        data = mapped(f"{self.folder}/grams-{shard:06d}.bin")
        lowest, contexts, n2, n3 = (int(x) for x in data[:32].view(U64))
        at, out = 32, []
        for _ in range(4):
            level, at = EliasFano.view(data, at)
            out.append(level)
        rest = at + (n2 + 7 & ~7)
        last = rest + (n2 + 7 & ~7)
        return lowest, contexts, *out, data[at : at + n2], data[rest : rest + n2], data[last : last + n3]

    def _inside(self, pointers: EliasFano, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Whether each child lies among its parent's."""
        return (pointers[parent].astype(np.int64) <= child) & (child < pointers[parent + 1].astype(np.int64))

    def find(self, context: np.ndarray, before: np.ndarray, count: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """(shard, place in it or -1, log10 P(word | context), log10 of the weight that it leaves as a context) of bigrams sorted by (context, word)."""
        shards = self.place(before, count, word)
        place, value, rest = np.full(len(word), -1, dtype=np.int64), np.zeros(len(word)), np.zeros(len(word))
        for shard in np.unique(shards).tolist():
            if shard not in self.sizes:
                continue
            s, e = np.searchsorted(shards, (shard, shard + 1)).tolist()
            lowest, contexts, pointers, level, _, _, codes, rests, _ = self.open(shard)
            rank = context[s:e] - lowest
            rows = np.flatnonzero((rank >= 0) & (rank < contexts))
            child = level.find(rank[rows].astype(U64) * U64(self.words.distinct + 1) + word[s:e][rows].astype(U64))
            rows, child = rows[child >= 0], child[child >= 0]
            own = self._inside(pointers, rank[rows], child)
            rows, child = rows[own] + s, child[own]
            place[rows], value[rows], rest[rows] = child, restored(codes[child]), restored(rests[child])
        return shards, place, value, rest

    def follow(self, shards: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """What the third level keeps of each word after a bigram, 0 where it has none; rows sorted by (shard, place, word)."""
        out = np.zeros(len(word))
        for shard in np.unique(shards).tolist():
            s, e = np.searchsorted(shards, (shard, shard + 1)).tolist()
            _, _, _, _, pointers, level, _, _, codes = self.open(shard)
            child = level.find(place[s:e].astype(U64) * U64(self.words.distinct + 1) + word[s:e].astype(U64))
            rows = np.flatnonzero(child >= 0)
            rows = rows[self._inside(pointers, place[s:e][rows], child[rows])]
            out[s + rows] = 10.0 ** restored(codes[child[rows]])
        return out


class Slice:
    """The tokens of some texts by the ids of their words. Numbers are those of the slice's distinct words in the order of their ids; unknown words come first, and the number after the last word's is that of a text's beginning."""

    def __init__(self, texts: pa.Array, words: Words, n_texts: int):
        known, index, self.counts = tokens(texts)
        ids, n, before = words.find(known)
        order = np.argsort(ids, kind="stable")
        self.ids, self.n, self.before = (np.append(x[order], y) for x, y in ((ids, words.distinct), (n, n_texts), (before, words.total)))
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.arange(len(order))
        self.word = number[index]
        self.size = len(order) + 1
        self.first = np.zeros(len(index), dtype=bool)
        self.first[np.cumsum(self.counts) - self.counts] = True
        self.last = np.append(self.first[1:], True)
        self.context = np.where(self.first, self.size - 1, np.roll(self.word, 1))
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)


def grouped(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, number of each row's pair) of the distinct pairs of numbers, sorted; b below size."""
    wide = (size - 1).bit_length()
    if int(a.max(initial=0)).bit_length() + wide > 63:
        raise OverflowError("a slice of too many tokens")
    pair, number = np.unique((a << wide) | b, return_inverse=True)
    return pair >> wide, pair & ((1 << wide) - 1), number


class Model:
    """A trained model: its levels, and what it was trained on."""

    def __init__(self, words: Words, grams: Grams):
        self.words, self.grams = words, grams

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Add-one probability of words with these counts."""
        return (counts + 1) / (self.words.total + self.words.distinct + 1)

    def score(self, x: Slice) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token of a slice: by the unigram, and by the model."""
        g = self.grams
        base = np.log10(self.unigram(x.n[x.word].astype(np.float64)))
        context, word, pair = grouped(x.context, x.word, x.size)
        count = np.maximum(x.n[context], 0)
        value = np.log10(g.prior / (count + g.prior)) + np.log10(self.unigram(x.n[word].astype(np.float64)))  # of a bigram that wasn't seen
        seen = np.flatnonzero((x.ids[context] >= 0) & (x.ids[word] >= 0))
        shard, place, rest = np.zeros(len(context), dtype=np.int64), np.full(len(context), -1, dtype=np.int64), np.zeros(len(context))
        if len(seen):
            at, found, log2, left = g.find(x.ids[context[seen]], x.before[context[seen]], count[seen], x.ids[word[seen]])
            hit = found >= 0
            shard[seen[hit]], place[seen[hit]], value[seen[hit]], rest[seen[hit]] = at[hit], found[hit], log2[hit], left[hit]
        two = value[pair]
        after = np.roll(pair, 1)  # the bigram before each token
        rows = np.flatnonzero(~x.first)
        rows = rows[place[after[rows]] >= 0]
        if not len(rows):
            return base, two
        up, word, triple = grouped(after[rows], x.word[rows], x.size)
        kept = np.zeros(len(up))
        known = np.flatnonzero(x.ids[word] >= 0)
        kept[known] = g.follow(shard[up[known]], place[up[known]], x.ids[word[known]])
        out = two.copy()
        out[rows] = np.log10(kept[triple] + 10.0 ** (rest[after[rows]] + two[rows]))
        return base, out


def train(docs: DataFrame, folder: str, is_held_out: Callable = held_out, prior: float = PRIOR, prior3: float = PRIOR3) -> Model:
    """Count the words, then the bigrams and trigrams, of all documents that aren't held out, and write the levels below `folder`. docs: id, text."""
    spark = docs.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = (shards - 1).bit_length()

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
        for batch in batches:
            for ids, part in slices(batch):
                learn = np.array([not is_held_out(i) for i in ids], dtype=bool)
                if learn.any():
                    yield part.filter(pa.array(learn))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()

        def emit() -> Iterator[pa.RecordBatch]:
            keys, n = sums.take()
            yield from blobs((keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64), keys, n)

        for part in learned(batches):
            known, index, _ = tokens(part)
            n = np.bincount(index, minlength=len(known))
            sums.add(known[n > 0], n[n > 0])
            if sums.held > GATHERED:
                yield from emit()
        yield from emit()

    counted = docs.mapInArrow(count_words, BLOB).repartitionById(1 << bits, F.col("shard"))

    def put_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, parts in shard_runs(batches, 2):
            keys, n = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            row = (*write_words(folder, bits, shard, keys, n.astype(np.int64)), int(n[keys == U64(END)].sum()))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=["shard", "words", "tokens", "texts"])

    rows = cut(counted.mapInArrow(put_words, "shard long, words long, tokens long, texts long")).collect()  # one row a shard
    words, texts = Words(folder, bits, {r[0]: (r[1], r[2]) for r in rows}), sum(r[3] for r in rows)
    grams = Grams(folder, words, texts, shards, prior, prior3)

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every token with the one before it and the one after it, or none at the end: each bigram and each trigram once."""
        for part in learned(batches):
            x = Slice(part, words, texts)
            context, word, pair = grouped(x.context, x.word, x.size)
            pair, following, number = grouped(pair, np.where(x.last, 0, np.roll(x.word, -1) + 1), x.size + 1)
            n = np.bincount(number, minlength=len(pair))
            context, word = context[pair], word[pair]
            key = (x.ids[context].astype(U64) << U64(32)) | x.ids[word].astype(U64)
            after = np.where(following > 0, x.ids[following - 1] + 1, 0)
            yield from blobs(grams.place(x.before[context], x.n[context], x.ids[word]), key, after, n)

    paired = docs.mapInArrow(count_grams, BLOB).repartitionById(grams.count, F.col("shard"))

    def put_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = sorted(words.starts, key=words.starts.get)
        first = np.array([words.starts[s] for s in starts], dtype=np.int64)

        def counts_of(ids: np.ndarray) -> np.ndarray:
            out, own = np.full(len(ids), texts, dtype=np.int64), np.searchsorted(first, ids, side="right") - 1
            for k in np.unique(own).tolist():
                here = np.flatnonzero((own == k) & (ids < words.distinct))  # the id after the last is a text's beginning
                sums = words._open(starts[k])[1]
                out[here] = (sums[ids[here] - first[k] + 1] - sums[ids[here] - first[k]]).astype(np.int64)
            return out

        for shard, parts in shard_runs(batches, 3):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in grams.build(shard, parts, counts_of)], names=["shard", "bigrams", "trigrams"])

    grams.sizes = {r[0] for r in cut(paired.mapInArrow(put_grams, "shard long, bigrams long, trigrams long")).collect()}  # one row a shard
    return Model(words, grams)


def score(docs: DataFrame, model: Model, is_held_out: Callable = held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the add-one unigram log10 probability of the whole text, score the model's.
    A null text is empty: its only token is the end; a very long one is scored whole, in a slice
    of its own. A null id is no held-out one. Null and
    repeated ids are kept; other columns are ignored. Untrained, every word has count 0. Map only.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")], T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    words, grams = model.words, model.grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for ids, part in slices(batch):
                x = Slice(part, words, grams.texts)
                base, value = Model(words, grams).score(x)
                total = lambda v, x=x: np.bincount(x.doc, v, minlength=len(x.counts))
                cols = [batch.column(0).slice(start, len(ids)), pa.array([is_held_out(i) for i in ids]), pa.array(x.counts.astype(np.int64)), pa.array(total(x.n[x.word] > 0).astype(np.int64)), pa.array(np.full(len(ids), words.total, dtype=np.int64)), pa.array(total(base)), pa.array(total(value))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
                start += len(ids)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def train_and_score(docs: DataFrame, folder: str, is_held_out: Callable = held_out, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, prior3: float = PRIOR3) -> DataFrame:
    """train() on the documents that aren't held out, then score() all."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return score(docs, train(source, folder, is_held_out, prior, prior3), is_held_out, id_col, text_col)
