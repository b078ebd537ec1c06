"""Phrase collocations: phrases of words that stand together more often than their parts would.

The n-grams of every size are exploded into rows (language, phrase, times), already summed
over some megabytes of text, and aggregated by Spark. What follows is joins: each phrase with
the counts of the two parts of every cut, an exact score in Decimal, an anti join with the
phrases that are one word longer, and a ranking by windows.

A phrase that occurs `least` times has parts that do, and so has its hash. So the sizes are
counted one after the other: first the hashes of those n-grams whose (n - 1)-grams' hashes are
frequent, in rows of two numbers; then, in the pass that counts the next size's hashes, the n-grams
themselves whose hash is frequent. What is frequent is looked up in a bitmap of hashes: of
fixed size, so that it may be broadcast, and such that no frequent phrase is ever left out; a full
bitmap only lets more rows through, and the counts that decide are those of the phrases themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only, pieces

#: A-Z to a-z, what ends a piece to a line feed, a tab to a space.
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Bytes of text whose phrases are summed before they become rows, and rows sent at a time.
TEXT, ROWS = 8 << 20, 1 << 16
#: The bitmap's size in 64-bit words, as a power of two: 16 MB.
BITMAP = 21
MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, from the words' own hashes."""
    out = words[: max(0, len(words) - n + 1)].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * MIX + words[i : len(words) - n + 1 + i]
    return (out ^ (out >> np.uint64(32))) * MIX


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def distinct_grams(ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different n-gram that begins at one of the places, and how often it does."""
    code = ids[at].astype(np.int64)
    for i in range(1, n):
        _, code = np.unique(code * (int(ids.max()) + 1) + ids[at + i], return_inverse=True)
    _, first, times = np.unique(code, return_index=True, return_counts=True)
    return at[first], times


def bits_of(at: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    return (frequent[at >> np.uint64(64 - BITMAP)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def grams(lang: str, texts: list[bytes], named: int, hashed: int, frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of the n-grams within pieces: those of `named` words that may be frequent as phrases, those of `hashed` words whose parts may be as hashes (0: none).

    frequent: the bitmap of the n-grams of `named` words, which are one word shorter than the hashed; None: all may be.
    With words named, one more row, of the empty phrase, counts all words.
    """
    chars = np.frombuffer(b"\n".join(texts).translate(PLAIN), dtype=np.uint8)
    inside = np.concatenate(([False], (chars != 32) & (chars != 10), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return
    piece = np.searchsorted(np.flatnonzero(chars == 10), starts)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    known = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars[inside[1:-1]])]).dictionary_encode()
    ids, words = known.indices.to_numpy(), known.dictionary
    del chars, inside, edges, known
    together = lambda n: piece[: max(0, len(ids) - n + 1)] == piece[n - 1 :]
    own = word_hashes(lang, words.to_pylist())[ids] if hashed or frequent is not None else None
    short = named or hashed - 1
    may = bits_of(hashes(own, short), frequent) if frequent is not None and short else None
    if hashed and len(ids) >= hashed:
        possible = together(hashed)
        if may is not None:
            possible &= may[: len(possible)] & may[1 : len(possible) + 1]
        found, times = np.unique(hashes(own, hashed)[possible], return_counts=True)
        for i in range(0, len(found), ROWS):
            part = found[i : i + ROWS].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.string()), pa.array(part), pa.array(times[i : i + ROWS].astype(np.int64))], names=NAMES)
    if named and len(ids) >= named:
        at, times = distinct_grams(ids, np.flatnonzero(together(named) if may is None else together(named) & may), named)
        for i in range(0, len(at), ROWS):
            part = at[i : i + ROWS]
            phrase = pc.binary_join_element_wise(*(words.take(pa.array(ids[part + k])) for k in range(named)), pa.scalar(b" ", pa.large_binary()))
            yield rows(lang, phrase.cast(pa.large_string()).cast(pa.string()), times[i : i + ROWS])
    if named == 1:
        yield rows(lang, pa.array([""]), np.array([len(ids)]))


NAMES = ["key", "hash", "times"]


def rows(lang: str, phrase: pa.Array, times: np.ndarray) -> pa.RecordBatch:
    """Language and phrase as one key, with a line feed between, which no phrase holds: of a row of short strings each further column is a large part."""
    key = pc.binary_join_element_wise(pa.scalar(lang), phrase, pa.scalar("\n"))
    return pa.RecordBatch.from_arrays([key, pa.nulls(len(key), pa.int64()), pa.array(times.astype(np.int64))], names=NAMES)


def counted(docs: DataFrame, named: int, hashed: int, least: int, frequent: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of the n-grams of `named` words, (hash) of those of `hashed` words), of f >= least; with words named also the empty phrase with the number of words."""
    bits = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in pieces(batch, "text"):
                for lang, text in zip(langs[first : first + len(texts)], texts, strict=True):
                    held.setdefault(lang, []).append(text)
                    size[lang] = size.get(lang, 0) + len(text)
                    while size.get(lang, 0) >= TEXT or sum(size.values()) >= 2 * TEXT:
                        most = max(size, key=size.get)
                        del size[most]
                        yield from grams(most, held.pop(most), named, hashed, bits.value)
        for lang, texts in held.items():
            yield from grams(lang, texts, named, hashed, bits.value)

    found = docs.mapInArrow(run, "key string, hash long, times long").groupBy("key", "hash").agg(F.sum("times").alias("f"))
    found = cut(found.where((F.col("f") >= least) | F.endswith("key", F.lit("\n"))))
    phrase = F.substring_index("key", "\n", -1)
    lang = F.substring("key", F.lit(1), F.char_length("key") - F.char_length(phrase) - 1)
    return found.where("key is not null").select(lang.alias("lang"), phrase.alias("phrase"), "f"), found.where("key is null").select("hash")


def hashed_words(found: DataFrame) -> DataFrame:
    """(hash) of (lang, phrase) of one word each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([hashes(word_hashes(lang, [word.encode()]), 1)[0] for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64))], names=["hash"])

    return found.where("phrase <> ''").select("lang", "phrase").mapInArrow(run, "hash long")


def bitmap(found: DataFrame) -> np.ndarray:
    """The bits of all hashes given; at most 2**BITMAP rows come to the driver, whatever their number."""
    out = np.zeros(1 << BITMAP, dtype=np.uint64)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("hash").bitwiseAND(F.lit(63)).cast("int"))
    sums = found.select(F.shiftrightunsigned("hash", 64 - BITMAP).alias("at"), bit.alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[sums["at"].to_numpy()] = sums["bits"].to_numpy().view(np.uint64)
    return out


def first_words(phrase, n):
    return F.substring_index(phrase, " ", n) if isinstance(n, int) else F.array_join(F.slice(F.split(phrase, " "), 1, n), " ")


def last_words(phrase, skip):
    words = F.split(phrase, " ")
    return F.array_join(F.slice(words, skip + 1, F.size(words) - skip), " ")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_n: int = 4, least: int = 30, scale: int = 2_000_000, covered: tuple[int, int] = (80, 100), top: int = 2000, prune: bool = True) -> DataFrame:
    """The collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at .,;:!? and at line ends, words at spaces and tabs.
    Candidates are phrases of 2 to max_n words within a piece that occur at least `least`
    times (a, overlaps included). A cut into two parts that occur l and r times scores
    floor(scale * a / (l + r)); the lowest cut counts, ties to the first. A phrase goes
    if a candidate that holds it occurs covered[0] / covered[1] of its times or more: of such
    candidates one is always one word longer, as all phrases between the two occur at least as
    often as the longer. n counts all words of the language.

    top: rows a language. A null language is `und`; null and empty texts
    have no words; a very long text is taken whole, in memory in proportion to it; repeated rows count each; ties in score and
    count are ranked by phrase in byte order; other columns aren't read. An empty table gives none.
    prune=False makes rows of all n-grams, with the same result.
    """
    source = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).where("text <> ''")
    levels: list[DataFrame] = []
    if prune:
        words, _ = counted(source, 1, 0, least, None)
        levels.append(words)
        hashes_of = hashed_words(words)
        for n in range(2, max_n + 2):  # each pass names the phrases of n - 1 words, if they are more than words, and hashes those of n
            frequent = bitmap(hashes_of)
            phrases, hashes_of = counted(source, n - 1 if n > 2 else 0, n if n <= max_n else 0, least, frequent)
            levels += [phrases] if n > 2 else []
    else:
        levels += [counted(source, n, 0, least, None)[0] for n in range(1, max_n + 1)]
    total = levels[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    count = levels[0].where("phrase <> ''").select("lang", "phrase", "f", F.lit(1).alias("words"))
    for n, level in enumerate(levels[1:], 2):
        count = count.unionByName(level.select("lang", "phrase", "f", F.lit(n).alias("words")))
    candidates = count.where("words > 1")
    part = lambda name, f: count.select("lang", F.col("phrase").alias(name), F.col("f").cast("decimal(20,0)").alias(f))

    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": first_words("phrase", F.col("k")), "tail": last_words("phrase", F.col("k"))})
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (l + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    longer = candidates.where("words > 2").select("lang", "f", F.explode(F.array(first_words("phrase", F.col("words") - 1), last_words("phrase", F.lit(1)))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("extended"))
    much = F.lit(covered[1]).cast("decimal(10,0)") * longer["extended"].cast("decimal(20,0)") >= F.lit(covered[0]).cast("decimal(10,0)") * scored["a"].cast("decimal(20,0)")
    left = scored.join(longer, (scored["lang"] == longer["lang"]) & (scored["phrase"] == longer["phrase"]) & much, "left_anti")

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    left = left.select("lang", "phrase", "a", F.col("cut.l").cast("long").alias("l"), F.col("cut.r").cast("long").alias("r"), F.col("cut.score").cast("long").alias("score"))
    # First within shares of a language, so that no task gets all its phrases.
    left = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    left = left.withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("at") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return left.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
