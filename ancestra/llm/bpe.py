"""BPE encoding and decoding by forced-boundary splitting.

Two adjacent bytes that never stand side by side inside any token of the vocabulary can
never be merged, so every encoding has a token boundary between them. Each pre-token is cut
at those pairs, the fragments are encoded on their own, and their ids are concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import Cache, only, pieces

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments of at most this many bytes are remembered.
REMEMBERED = 64


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file, reversed."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE vocabulary (the text of its JSON file).

    Added tokens are matched first and literally; the text between them is split into
    pre-tokens. Memory is bounded: the cache of fragments is emptied when full, and a
    fragment of n bytes takes O(n) space and O(n log n) time.
    """

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [x["content"] for x in spec.get("added_tokens", []) if x.get("single_word") or x.get("lstrip") or x.get("rstrip") or x.get("normalized")]
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or odd:
            raise ValueError("only byte-level vocabularies without a normalizer, with the usual pre-tokens and plain added tokens, can be encoded")
        alphabet = byte_alphabet()
        to_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = to_bytes(left), to_bytes(right)
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.joint = bytearray(1 << 16)
        for token in self.ids:
            for a, b in zip(token, token[1:], strict=False):
                self.joint[a << 8 | b] = 1
        self._split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self._words = regex.compile(PATTERN).findall
        self._fragments = Cache()
        self._known = Cache(800_000)

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut at every forced boundary."""
        joint = self.joint
        if len(word) <= REMEMBERED:
            cuts = [i for i, (a, b) in enumerate(zip(word, word[1:], strict=False), 1) if not joint[a << 8 | b]]
        else:
            x = np.frombuffer(word, dtype=np.uint8).astype(np.int64)
            cuts = (np.flatnonzero(np.frombuffer(joint, dtype=np.uint8)[x[:-1] << 8 | x[1:]] == 0) + 1).tolist()
        if not cuts:
            return [word]
        ends = [*cuts, len(word)]
        return [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one fragment: always the pair of lowest rank, leftmost first."""
        ids = [self.single[b] for b in fragment]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := self.merges.get((ids[i], ids[i + 1]))) is not None:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (m := self.merges.get((made, ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, made, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := self.merges.get((ids[h], made))) is not None:
                heapq.heappush(heap, (m[0], h, ids[h], made, m[1]))
        return [x for x in ids if x >= 0]

    def _encode_fragment(self, fragment: bytes) -> list[int]:
        if len(fragment) > REMEMBERED:
            return self.merge(fragment)
        if (got := self._fragments.get(fragment)) is None:
            self._fragments.room()
            got = self._fragments[fragment] = self.merge(fragment)
        return got

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        return [i for part in self.fragments(word.encode()) for i in self._encode_fragment(part)]

    def _parts(self, text: str) -> Iterator[tuple[bool, str]]:
        """The text cut at added tokens: (is an added token, part)."""
        if self._split_added is None:
            yield False, text
            return
        for i, part in enumerate(self._split_added.split(text)):
            if part:
                yield bool(i % 2), part

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        out: list[int] = []
        known = self._known
        for added, part in self._parts(text):
            if added:
                out.append(self.added[part])
                continue
            for word in self._words(part):
                if (got := known.get(word)) is None:
                    got = tuple(self.encode_word(word))
                    if len(word) <= REMEMBERED:
                        known.room()
                        known[word] = got
                out += got
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, special tokens included; broken UTF-8 is replaced."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids]).decode("utf-8", "replace")


_ENCODERS: dict[str, ForcedBoundaryBPE] = {}


def encoder(vocabulary: str) -> ForcedBoundaryBPE:
    """The encoder of a vocabulary; a worker process keeps the last one, and its caches, for its next tasks."""
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ForcedBoundaryBPE(vocabulary)
    return _ENCODERS[key]


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a vocabulary file at a local path of the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    vocabulary: the text of the tokenizer's JSON file. It is broadcast: its size is fixed
    (1.6 MB for the 50k vocabulary) and doesn't grow with the documents.

    Returns one row per input row: id, n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded text) and, if asked for, ids and decoded. A null
    text is an empty text: no token and the digests of nothing; a very long one is encoded whole, in
    memory in proportion to it. Null and repeated ids are
    kept; other columns, whatever their names, are left out. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(shared.value)
        only(bpe._fragments, bpe._known)
        shown = [str(i) for i in range(max(bpe.tokens) + 1)]
        for batch in batches:
            for start, texts in pieces(batch, "text"):
                counts, ids_sha, text_sha, all_ids, all_texts = [], [], [], [], []
                for raw in texts:
                    ids = bpe.encode((raw or b"").decode("utf-8", "replace"))
                    decoded = bpe.decode(ids)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join([shown[i] for i in ids]).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                        all_texts.append(decoded)
                cols = [batch.column(0).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                if with_ids:
                    cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts)]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return source.mapInArrow(run, T.StructType(fields))


def default_path() -> str:
    """The 50k byte-level vocabulary that the cluster's tokenizer package offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
