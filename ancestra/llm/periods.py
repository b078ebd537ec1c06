"""Periodic runs of words: stretches that repeat a short pattern several times over.

A run of period q has at least `times` patterns (and `least` words), so that at least
`step(q)` consecutive words equal the word q later, and one multiple of step(q) is among
them. The multiples of step(q) for all q form a harmonic grid of O(n log n) pairs
(period, grid point). For all pairs at once, a binary search over prefix hashes finds how
far the words from the point, and those before it, equal the words q later; that gives the
whole run. Runs found by several points are one; a stretch found by several periods has the
smallest as its period, the others being its multiples. All words of a run are compared in
the end; should a hash have misled, the search is done anew with other bases.

Many documents are searched together, with a word of its own after each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, pieces

#: Moduli of the prefix hashes: two primes below 2**31, so that products of residues fit 64 bits.
MODULI = (2147483647, 2147483629)
#: Pairs of the grid that are held at a time.
PAIRS = 1 << 19
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class PrefixHashes:
    """Equality of stretches of word numbers, by polynomial hashes under two moduli."""

    def __init__(self, words: np.ndarray, attempt: int = 0):
        self.levels = []
        for modulus in MODULI:
            base = (911_382_323 + 972_663_749 * attempt) % (modulus - 1000) + 500
            power = np.ones(len(words) + 1, dtype=np.uint32)
            done, factor = 1, base
            while done < len(power):  # power[done:] from power[:done], twice as many each time
                upto = min(2 * done, len(power))
                power[done:upto] = power[: upto - done].astype(np.int64) * factor % modulus
                done, factor = upto, factor * factor % modulus
            total = np.zeros(len(words) + 1, dtype=np.uint32)
            total[1:] = np.cumsum((words.astype(np.int64) + 1) * power[:-1] % modulus) % modulus
            self.levels.append((modulus, power, total))

    def equal(self, x: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from x hash as those from x + q."""
        same = np.ones(len(x), dtype=bool)
        for modulus, power, total in self.levels:
            here = (total[x + n].astype(np.int64) - total[x]) % modulus
            there = (total[x + q + n].astype(np.int64) - total[x + q]) % modulus
            same &= here * power[q] % modulus == there
        return same

    def extension(self, x: np.ndarray, q: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The most words from x (back: before x) that equal those q later; every pair's binary search takes its steps with all others."""
        low, high = np.zeros(len(x), dtype=np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            good = self.equal(x - mid if back else x, q, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low


def grid(n: int, longest: int, times: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point) for all periods of runs among n words, in slices of about PAIRS."""
    q = 1
    while times * q <= longest:
        some = np.arange(q, min(longest // times, q + PAIRS) + 1, dtype=np.int64)
        step = np.maximum(least, times * some) - some
        many = -(-(n - some) // step)
        some, step, many = (v[: max(1, int(np.searchsorted(np.cumsum(many), PAIRS)))] for v in (some, step, many))
        first = np.cumsum(many) - many
        yield np.repeat(some, many), (np.arange(int(many.sum()), dtype=np.int64) - np.repeat(first, many)) * np.repeat(step, many)
        q = int(some[-1]) + 1


def find_runs(words: np.ndarray, longest: int | None = None, times: int = 4, least: int = 6, attempt: int = 0) -> np.ndarray:
    """Rows (start, length, period) of all runs of equal numbers in `words`, by start, then period.

    longest: the longest run there can be, where it is known.
    """
    n = len(words)
    longest = n if longest is None else longest
    none = np.empty((0, 3), dtype=np.int64)
    if longest < least:
        return none
    hashes, found = PrefixHashes(words, attempt), [none]
    for q, x in grid(n, longest, times, least):
        met = words[x] == words[x + q]
        q, x = q[met], x[met]
        after = hashes.extension(x, q, n - x - q)
        before = hashes.extension(x, q, x, back=True)
        size = before + after + q
        kept = size >= np.maximum(least, times * q)
        found.append(np.unique(np.stack([(x - before)[kept], size[kept], q[kept]], axis=1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    if not len(runs):
        return none
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    own = runs[new]
    sure = bool((runs[:, 2] % np.repeat(own[:, 2], np.diff(np.append(np.flatnonzero(new), len(runs)))) == 0).all())
    for start, size, q in own.tolist() if sure else ():
        end = start + size
        sure = np.array_equal(words[start : end - q], words[start + q : end]) and not (start and words[start - 1] == words[start - 1 + q]) and not (end < n and words[end] == words[end - q])
        if not sure:
            break
    return own[np.lexsort((own[:, 2], own[:, 0]))] if sure else find_runs(words, longest, times, least, attempt + 1)


def runs_of_texts(texts: list[bytes | None], times: int = 4, least: int = 6) -> Iterator[tuple[list, bytes]]:
    """For each UTF-8 text its runs, as rows (start, length, period), and its words without what repeats, joined by spaces."""
    split = [(x or b"").split() for x in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    known = pa.array([x for w in split for x in w], pa.binary()).dictionary_encode()
    words = np.empty(int(sizes.sum()) + len(split), dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    stops = np.zeros(len(words), dtype=bool)
    stops[ends - 1] = True
    words[~stops] = known.indices.to_numpy(zero_copy_only=False)
    words[stops] = len(known.dictionary) + np.arange(len(split))
    del known
    runs = find_runs(words, int(sizes.max(initial=0)), times, least)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(edge[:-1]) > 0
    at = np.searchsorted(runs[:, 0], np.concatenate(([0], ends)))
    for i, own in enumerate(split):
        first = int(ends[i] - len(own) - 1)
        mine = runs[at[i] : at[i + 1]]
        if len(mine):
            mine = mine - np.array([first, 0, 0])
            own = [w for w, gone in zip(own, dropped[first : first + len(own)].tolist(), strict=True) if not gone]
        yield mine.tolist(), b" ".join(own)


def mark_runs(docs: DataFrame, text_col: str = "text", runs: str = "runs", collapsed: str = "collapsed", times: int = 4, least: int = 6) -> DataFrame:
    """All columns, the periodic runs of the whole text, and the text without their repetitions. Map only.

    Words lie between ASCII white space and are numbered from 0. A run is a stretch of
    smallest period q of max(least, times * q) words or more, as long as it can be; a word
    is left out of `collapsed` if any run holds it after its first q words. Null and empty
    texts have no run and an empty `collapsed`; a very long text is searched whole, in memory
    in proportion to it; repeated rows and ties each give their rows; other columns pass as
    they are, and existing columns of the two new names are replaced. An empty table gives none.
    """
    kept = docs.drop(*(c for c in docs.columns if c.lower() in (runs.lower(), collapsed.lower()) and c != text_col))
    schema = T.StructType([*kept.schema.fields, T.StructField(runs, T.ArrayType(RUN)), T.StructField(collapsed, T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for first, texts in pieces(batch, text_col):
                found = list(runs_of_texts(texts, times, least))
                spans = pa.array([[dict(zip(RUN.names, r, strict=True)) for r in rows] for rows, _ in found], kind)
                rest = pa.array([text for _, text in found], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns), spans, rest], names=schema.names)

    return kept.mapInArrow(run, schema)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which about a tenth, chosen by h = crc32 of the id, repeat a part of their own words from some word to the end.

    With g = floor(h / 10): if h % 10 = 0, every word i from a = g % n on becomes word
    a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). Rows without an id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    bound = lambda value, body: F.transform(F.array(value), body)[0]

    def repeated(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        return bound(F.struct(w.alias("w"), (g % n).alias("a"), g.alias("g"), n.alias("n")), lambda s: bound(
            F.struct(s["w"].alias("w"), s["a"].alias("a"), (F.lit(1) + F.floor((s["n"] - s["a"]) / (F.lit(3) + s["g"] % 8))).alias("p")),
            lambda t: F.array_join(F.transform(t["w"], lambda x, i: F.when(i >= t["a"], F.get(t["w"], (t["a"] + (i - t["a"]) % t["p"]).cast("int"))).otherwise(x)), " "),
        ))

    chosen = (h % 10 == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return docs.withColumn(text_col, F.when(chosen, bound(words, repeated)).otherwise(F.col(text_col)))


def digest(found: DataFrame, id_col: str = "doc_id", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Per document the number of runs, that of the greatest exponent (ties: the first by start, then period), and digests of all runs and of the text that is left."""
    best = F.aggregate(F.col(runs), F.get(F.col(runs), F.lit(0)), lambda m, r: F.when(r["length"] * m["period"] > m["length"] * r["period"], r).otherwise(m))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        id_col, F.size(runs).cast("long").alias("n_runs"), *(F.col("best")[c].alias(c) for c in RUN.names),
        F.floor(F.lit(1000) * F.col("best")["length"] / F.col("best")["period"]).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(collapsed, 256).alias("collapsed_sha256"),
    )
