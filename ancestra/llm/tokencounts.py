"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

The best segmentation of a pre-token is found by forward scores over its bytes. Distinct
pre-tokens are inserted in a trie whose nodes hold the forward score of their prefix, so a
prefix that pre-tokens share is scored once; the node at which a pre-token ends holds its count.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import PATTERN
from .common import Cache, only, pieces

#: Nodes after which a worker's trie is begun anew; results don't depend on it.
NODES = 600_000
#: Scores are integers, in millionths of a nat, so that sums are exact and ties are real.
SCALE = 1_000_000


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Log probabilities that fall with the rank by Zipf's law (1 / (rank + 2.7), normalised)."""
    total = math.log(sum(1 / (r + 2.7) for r in ranks.values())) if ranks else 0.0
    return {t: -round(SCALE * (math.log(r + 2.7) + total)) for t, r in ranks.items()}


def parse_ranks(text: str) -> dict[bytes, int]:
    """Lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


class TrieCounter:
    """Counts of the best segmentation: largest score, then fewest tokens. A byte that no piece covers is a token of the score `unknown`."""

    def __init__(self, scores: dict[bytes, int], most_nodes: int = NODES):
        self.scores = scores
        self.unknown = min(scores.values(), default=0) - 10 * SCALE
        self.ends = {t[i:] for t in scores for i in range(len(t))}
        self.most_nodes = most_nodes
        self.scored = 0
        self._new()

    def _new(self) -> None:
        self.root: list = [{}, 0, 0]  # children, forward score, tokens
        self.nodes = 1

    def count(self, word: bytes) -> int:
        """Tokens of a pre-token; its missing nodes are added."""
        if self.nodes + len(word) > self.most_nodes:
            self._new()
        node, path = self.root, [self.root]
        scores, ends = self.scores, self.ends
        for d, byte in enumerate(word, 1):
            child = node[0].get(byte)
            if child is None:
                before = path[d - 1]
                best, tokens = before[1] + self.unknown, before[2] + 1
                for start in range(d - 1, -1, -1):
                    piece = word[start:d]
                    if piece not in ends:
                        break
                    if (s := scores.get(piece)) is not None:
                        at = path[start]
                        if (total := at[1] + s) > best or total == best and at[2] + 1 < tokens:
                            best, tokens = total, at[2] + 1
                child = node[0][byte] = [{}, best, tokens]
                self.nodes += 1
                self.scored += 1
            path.append(child)
            node = child
        return node[2]


def segment_count(word: bytes, scores: dict[bytes, int], unknown: int) -> int:
    """The same count for one pre-token alone, without a trie (for tests)."""
    best = [(0, 0)]
    for d in range(1, len(word) + 1):
        options = [(best[d - 1][0] + unknown, -best[d - 1][1] - 1)]
        options += [(best[i][0] + scores[word[i:d]], -best[i][1] - 1) for i in range(d) if word[i:d] in scores]
        s, t = max(options)
        best.append((s, -t))
    return best[-1][1]


_COUNTERS: dict[int, tuple] = {}


def count_tokens(docs: DataFrame, scores: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """One row per input row: id, n_pretokens, n_bytes, n_tokens, over the whole text.

    scores: pieces (bytes) and their log probabilities in millionths; broadcast, of a size that
    the vocabulary fixes. A null or empty text has no tokens; a very long one is counted whole.
    Null and repeated ids are kept;
    only the id and the text are read. Map only; a worker's trie and its table of terminal
    counts are bounded.
    """
    key = hash(frozenset(scores.items()))
    shared = docs.sparkSession.sparkContext.broadcast(scores)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, T.LongType()) for n in ("n_pretokens", "n_bytes", "n_tokens")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = (TrieCounter(shared.value), Cache(800_000))
        counter, known = _COUNTERS[key]
        only(known)
        split = regex.compile(pattern).findall
        for batch in batches:
            for start, texts in pieces(batch, "text"):
                words_n, bytes_n, tokens_n = [], [], []
                for raw in texts:
                    words = split((raw or b"").decode("utf-8", "replace"))
                    total = 0
                    for w in words:
                        if (n := known.get(w)) is None:
                            n = counter.count(w.encode())
                            if len(w) <= 64:
                                known.room()
                                known[w] = n
                        total += n
                    words_n.append(len(words))
                    bytes_n.append(len(raw or b""))
                    tokens_n.append(total)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(words_n, pa.int64()), pa.array(bytes_n, pa.int64()), pa.array(tokens_n, pa.int64())], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def default_ranks_path() -> str:
    """The ranks of the 50k byte-level vocabulary that the cluster's tokenizer package offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
