"""Quality classification by importance resampling with hashed n-gram models.

Two generative models of hashed unigrams and bigrams are estimated: one of the target text
(labelled documents of good quality) and one of the raw text (all documents). A document's
log importance weight is the sum over its n-grams of log(target / raw). Adding Gumbel noise to
the log weights and taking the k largest draws k documents without replacement in proportion
to their weights; these are accepted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, cut, only, pieces, unused

#: Words and runs of punctuation of a UTF-8 text; case is kept.
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
BUCKETS = 1 << 16
#: Labelled documents of which the target model and the threshold are fitted, at most.
LABELLED = 20_000
ALPHA = 1.0
SEED = 17
#: The least share of the good labelled documents that the fitted threshold accepts.
KEEP_GOOD = 0.999
_TOKENS = Cache()


def _codes(tokens: list[bytes]) -> np.ndarray:
    out, known = [], _TOKENS
    for t in tokens:
        if (c := known.get(t)) is None:
            known.room()
            c = xxhash.xxh64_intdigest(t)
            if len(t) <= 64:
                known[t] = c
        out.append(c)
    return np.array(out, dtype=np.uint64)


def features(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of the text's unigrams and bigrams, repeats included."""
    h = _codes(TOKEN.findall(text))
    if not len(h):
        return np.empty(0, np.int64)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pair ^= pair >> np.uint64(32)
    return (np.concatenate([h, pair]) % np.uint64(buckets)).astype(np.int64)


def gumbel(row_id, seed: int = SEED) -> float:
    """Standard Gumbel noise that depends on the id and the seed alone."""
    u = (xxhash.xxh64_intdigest(str(row_id).encode(), seed) + 0.5) / 2.0**64
    return -math.log(-math.log(u))


def ratios(target: np.ndarray, raw: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """log(target / raw) of every bucket, both with additive smoothing; zeros where there is no target text."""
    if not target.sum():
        return np.zeros(len(raw))
    share = lambda n: np.log((n + alpha) / (n.sum() + alpha * len(n)))
    return share(target) - share(raw)


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most `most` labelled ids (id, good), drawn by a hash of the id. An id with clashing labels counts as bad."""
    one = labels.select(labels[id_col].alias("lid"), labels[label_col].alias("q")).where("lid is not null and q is not null").groupBy("lid").agg((F.min("q") > 0).alias("good"))
    return one.orderBy(F.xxhash64("lid"), "lid").limit(most)


def counts(docs: DataFrame, sample: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) n-gram counts: of the good labelled documents, and of all documents. docs: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_TOKENS)
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(1).to_pylist()
            for start, texts in pieces(batch, "text"):
                for i, text in enumerate(texts, start):
                    if text and len(f := features(text, buckets)):
                        n = np.bincount(f, minlength=buckets)
                        raw += n
                        if good[i]:
                            target += n
        hit = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(raw[hit]), pa.array(target[hit])], names=["b", "r", "t"])

    joined = docs.join(F.broadcast(sample), docs["id"] == sample["lid"], "left").select("text", "good")
    total = joined.mapInArrow(run, "b long, r long, t long").groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in total.collect():  # as many rows at most as buckets
        raw[b], target[b] = r, t
    return target, raw


def scored(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, keep: list[str], seed: int = SEED, names: tuple[str, str, str] = ("__n", "__weight", "__key")) -> DataFrame:
    """The columns `keep` of docs with __n (n-grams), __weight (log importance) and __key (with Gumbel noise). Map only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, t()) for n, t in zip(names, (T.LongType, T.DoubleType, T.DoubleType), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_TOKENS)
        lam = shared.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            n, w = [], []
            for _, texts in pieces(batch, text_col):
                for text in texts:
                    f = features(text or b"", len(lam))
                    n.append(len(f))
                    w.append(float(lam[f].sum()))
            key = [x + gumbel(i, seed) for x, i in zip(w, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(n, pa.int64()), pa.array(w, pa.float64()), pa.array(key, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def threshold(good: np.ndarray, bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The log weight that separates the labelled documents best among those that accept keep_good of the good ones."""
    if not len(good):
        return 0.0
    ceiling = np.sort(good)[min(len(good) - 1, int(math.floor((1 - keep_good) * len(good))))]
    if not len(bad):
        return float(ceiling)
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([cuts[cuts <= ceiling], [ceiling]])
    right = np.searchsorted(np.sort(bad), cuts) / len(bad) - np.searchsorted(np.sort(good), cuts) / len(good)
    best = cuts[right == right.max()]
    lower = bad[bad < best[-1]]
    return float((best[-1] + lower.max()) / 2) if len(lower) else float(best[-1])


def kth_largest(keyed: DataFrame, k: int, key: str = "__key", bins: int = 4096) -> float:
    """The k-th largest value of a double column, exactly, without sorting all rows.

    Each round counts the rows of `bins` intervals between the smallest and the largest value
    left and goes on in the interval that holds the k-th, so at most `bins` rows come to the
    driver in a round.
    """
    part, c = keyed.select(F.col(key).alias("v")), F.col("v")
    n, lo, hi = part.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if k <= 0 or not n:
        return math.inf
    if k >= n:
        return -math.inf
    while lo < hi:
        number = F.least(F.floor((c - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1))
        rows = part.where(c.between(lo, hi)).groupBy(number.alias("i")).agg(F.count("v"), F.min("v"), F.max("v")).collect()
        for _, n, low, high in sorted(rows, reverse=True):
            if k <= n:
                lo, hi = low, high
                break
            k -= n
    return lo


class Fitted:
    """Bucket weights, the labelled documents' threshold, the keyed rows (id, n_grams, weight, key) and the k-th key."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id_col: str, label_col: str, k: int | None, buckets: int, most_labelled: int, seed: int):
        self.sample = cut(labelled_sample(labels, label_id_col, label_col, most_labelled))
        source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
        self.weights = ratios(*counts(source, self.sample, buckets))
        self.keyed = cut(scored(source, self.weights, "id", "text", ["id"], seed))
        seen = self.keyed.join(F.broadcast(self.sample), self.keyed["id"] == self.sample["lid"]).groupBy("lid", "good").agg(F.min("__weight").alias("w")).select("good", "w").collect()  # most_labelled rows at most
        self.threshold = threshold(np.array([w for good, w in seen if good]), np.array([w for good, w in seen if not good]))
        self.k = self.keyed.where(F.col("__weight") >= self.threshold).count() if k is None else k
        self.bound = kth_largest(self.keyed, self.k)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", k: int | None = None, buckets: int = BUCKETS, most_labelled: int = LABELLED, seed: int = SEED) -> DataFrame:
    """One row per document: id, n_grams, log_weight, gumbel_key, accepted.

    The raw model counts all documents. The target model and the threshold are fitted on at
    most `most_labelled` labelled documents, drawn by a hash of the id. k, the number of
    documents to accept, is by default the number whose log weight reaches the threshold.
    Documents whose keys tie with the k-th are accepted with it. Null and empty texts have no
    n-gram and weight 0, and are judged by that; a very long text is counted whole, in memory in
    proportion to it. Null ids share one noise value; repeated rows
    have equal keys. Without labels, target and raw differ by nothing and all are accepted.
    Other columns are ignored, whatever their names.
    """
    fit = Fitted(docs, labels, id_col, text_col, label_id_col, label_col, k, buckets, most_labelled, seed)
    return fit.keyed.select(F.col("id").alias(id_col), F.col("__n").alias("n_grams"), F.col("__weight").alias("log_weight"), F.col("__key").alias("gumbel_key"), (F.col("__key") >= F.lit(fit.bound)).alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", k: int | None = None, buckets: int = BUCKETS, most_labelled: int = LABELLED, seed: int = SEED) -> DataFrame:
    """The rows of docs, with all their columns, that classify() accepts. The last pass is a map: nothing is joined back."""
    fit = Fitted(docs, labels, id_col, text_col, label_id_col, label_col, k, buckets, most_labelled, seed)
    names = tuple(unused(docs, n) for n in ("n_grams", "log_weight", "gumbel_key"))
    return scored(docs, fit.weights, id_col, text_col, docs.columns, seed, names).where(F.col(names[2]) >= F.lit(fit.bound)).select(*docs.columns)
