"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest.

The trees are boosted on the logistic loss with histogram splits, from a bounded sample of
labelled URLs. The features are lexical: lengths, depths, digit ratio, entropy, parameter
counts and the statistics of the host's suffix among the labelled URLs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled URLs that the trees are fitted on, at most; drawn by a hash of the URL.
LABELLED = 20_000
FEATURES = ("length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters", "fragment", "longest_digits", "suffix_rate", "suffix_share")
_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")
_DIGITS = re.compile(r"[0-9]+")
BINS = 64


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path). Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end. Both empty without "://"."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = m.start() if (m := _END.search(rest)) else len(rest)
    path = rest[cut:]
    return rest[:cut].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path[: m.start()] if (m := _PATH_END.search(path)) else path


class Rules:
    """Rules (action, "host/path"). One fits its host and all subdomains if the URL's path starts with the rule's; the longest wins, by host and then by path."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, pattern in rules:
            cut = pattern.find("/")
            host, path = (pattern[:cut], pattern[cut:]) if cut >= 0 else (pattern, "")
            self.by_host.setdefault(host, []).append((path, action, pattern))
        for v in self.by_host.values():
            v.sort(key=lambda x: -len(x[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits."""
        while host:
            for start, action, pattern in self.by_host.get(host, ()):
                if path.startswith(start):
                    return action, pattern
            host = host.partition(".")[2]
        return None


def suffix_of(host: str) -> str:
    return host.rpartition(".")[2]


def lexical(url: str | None, suffixes: dict[str, tuple[float, float]]) -> list[float]:
    """The features of one URL, in the order of FEATURES. suffixes: rate of blocked and share among labelled URLs."""
    url = url or ""
    host, path = split_url(url)
    n = len(url)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    digits = _DIGITS.findall(url)
    query = url.partition("#")[0].partition("?")[2]
    rate, share = suffixes.get(suffix_of(host), suffixes.get("", (0.5, 0.0)))
    return [n, len(host), len(path), host.count(".") + 1 if host else 0, sum(map(bool, path.split("/"))), sum(map(len, digits)) / n if n else 0.0, entropy, query.count("&") + 1 if query else 0, float("#" in url), max(map(len, digits), default=0), rate, share]


def suffix_statistics(urls: list[str], y: np.ndarray, prior: float = 10.0) -> dict[str, tuple[float, float]]:
    """suffix -> (smoothed rate of blocked, share of the labelled URLs); the key "" is for suffixes not seen. One entry per labelled URL at most."""
    base = float(y.mean()) if len(y) else 0.5
    found: dict[str, list[float]] = {}
    for url, label in zip(urls, y.tolist(), strict=True):
        x = found.setdefault(suffix_of(split_url(url)[0]), [0.0, 0.0])
        x[0] += label
        x[1] += 1
    return {k: ((b + prior * base) / (n + prior), n / len(urls)) for k, (b, n) in found.items()} | {"": (base, 0.0)}


class BoostedTrees:
    """Logistic gradient boosting with histogram trees of bounded depth. Deterministic; the model's size is fixed by its parameters."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.1, least: float = 20.0, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.least, self.penalty = trees, depth, rate, least, penalty
        self.base, self.model, self.cuts = 0.0, [], []

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if len(self.cuts) else np.zeros((len(x), 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        if not len(y):
            return self
        p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
        self.base = math.log(p / (1 - p))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        if y.min() == y.max():
            return self
        b, f = self._bins(x), np.full(len(y), self.base)
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            tree = self._tree(b, q - y, q * (1 - q))
            if tree is None:
                break
            self.model.append(tree)
            f += self._apply(tree, b)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> list | None:
        def grow(rows: np.ndarray, depth: int) -> list:
            gs, hs = g[rows].sum(), h[rows].sum()
            leaf = ["leaf", -self.rate * gs / (hs + self.penalty)]
            if depth == 0 or len(rows) < 2 * self.least:
                return leaf
            best, choice = 1e-6, None
            for j in range(b.shape[1]):
                bins = b[rows, j]
                n = np.cumsum(np.bincount(bins, minlength=BINS))
                gl = np.cumsum(np.bincount(bins, g[rows], BINS))
                hl = np.cumsum(np.bincount(bins, h[rows], BINS))
                gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                if gain.max() > best + 1e-9:
                    best, choice = gain.max(), (j, int(gain.argmax()))
            if choice is None:
                return leaf
            left = b[rows, choice[0]] <= choice[1]
            return [*choice, grow(rows[left], depth - 1), grow(rows[~left], depth - 1)]

        tree = grow(np.arange(len(g)), self.depth)
        return None if tree[0] == "leaf" else tree

    def _apply(self, tree: list, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b))

        def walk(node: list, rows: np.ndarray) -> None:
            if node[0] == "leaf":
                out[rows] = node[1]
                return
            left = b[rows, node[0]] <= node[1]
            walk(node[2], rows[left])
            walk(node[3], rows[~left])

        walk(tree, np.arange(len(b)))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of block."""
        b, f = self._bins(x), np.full(len(x), self.base)
        for tree in self.model:
            f += self._apply(tree, b)
        return 1 / (1 + np.exp(-f))


def sample(labelled: DataFrame, most: int, url_col: str = "url", label_col: str = "block") -> tuple[list[str], np.ndarray]:
    """At most `most` different labelled URLs; one with clashing labels counts as blocked."""
    rows = labelled.select(labelled[url_col].alias("u"), labelled[label_col].cast("int").alias("y")).where("u is not null and y is not null").groupBy("u").agg(F.max("y").alias("y")).orderBy(F.xxhash64("u"), "u").limit(most).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=float)


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", most_labelled: int = LABELLED, cut: float = 0.5, **options) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict ("allow" or "block"), score.

    labelled: (url, block) rows of which the trees learn; at most most_labelled are used. Where
    no rule fits, verdict is block if the trees' probability (score) is over `cut`. A null URL
    or one without "://" has an empty host and path and is judged by the trees; a very long one is
    judged whole. Without labels
    the score is 0.5 and the verdict allow. Null and repeated ids are kept; only the id and the
    URL are read. Map only, but for drawing the sample.
    """
    urls, y = sample(labelled, most_labelled)
    suffixes = suffix_statistics(urls, y)
    model = BoostedTrees(**options).fit(np.array([lexical(u, suffixes) for u in urls], dtype=float).reshape(-1, len(FEATURES)), y)
    find = Rules(rules).find
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            split = [split_url(u) for u in given]
            ruled = [find(*s) for s in split]
            score = model.predict(np.array([lexical(u, suffixes) for u in given], dtype=float).reshape(-1, len(FEATURES)))
            verdict = [r[0] if r else "block" if s > cut else "allow" for r, s in zip(ruled, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), pa.array([r[1] if r else None for r in ruled], pa.string()), pa.array(verdict, pa.string()), pa.array(score)], names=schema.names)

    return pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("u")).mapInArrow(run, schema)


def labelled_by_document(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, block): URLs whose last path number is a labelled document; block if it is of low quality or toxic."""
    numbered = pages.select(pages[url_col].alias("url"), F.regexp_extract(pages[url_col], r"://[^/?#]*/[^?#]*?([0-9]+)[^0-9/?#]*/?(?:[?#].*)?$", 1).try_cast("long").alias("n"))
    known = labels.select(labels["doc_id"].alias("d"), ((F.coalesce(labels["quality"], F.lit(1)) == 0) | (F.coalesce(labels["toxic"], F.lit(0)) == 1)).alias("block"))
    return numbered.where("n is not null").join(known, F.col("n") == F.col("d")).select("url", "block")
