"""Elias-Fano sequences that are read in place from memory-mapped words, many queries at a time."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, one after the other, in 64-bit words (and one spare word)."""
    n = len(values)
    words = np.zeros((n * width + 63) // 64 + 1, dtype=U64)
    if not width or not n:
        return words
    at = np.arange(n, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(U64)
    np.bitwise_or.at(words, word, values << shift)
    over = (at & 63) + width > 64
    np.bitwise_or.at(words, word[over] + 1, values[over] >> (U64(64) - shift[over]))
    return words


def _nth_one(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th set bit (from 0) of each word."""
    place, words, rank = np.zeros(len(words), dtype=np.int64), words.copy(), rank.copy()
    for step in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(words & U64((1 << step) - 1)).astype(np.int64)
        up = rank >= ones
        rank -= np.where(up, ones, 0)
        words = np.where(up, words >> U64(step), words)
        place += np.where(up, step, 0)
    return place


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary, and the ones before each word.

    Takes about 2 + log2(universe / n) bits a value and one for the directory.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones, self.zeros = n, width, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values: sorted, below universe."""
        values = np.asarray(values, dtype=U64)
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = _pack(values & U64((1 << width) - 1), width)
        tops = (values >> U64(width)).astype(np.int64)
        size = n + (max(0, universe - 1) >> width) + 2
        high = np.zeros((size + 63) // 64 + 1, dtype=U64)
        at = tops + np.arange(n, dtype=np.int64)
        np.bitwise_or.at(high, at >> 6, U64(1) << (at & 63).astype(U64))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64))).astype(np.uint32)
        zeros = (np.arange(len(high) + 1, dtype=np.int64) * 64 - ones).astype(np.uint32)
        return cls(n, width, low, high, ones, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width, len(self.low), len(self.high)], dtype=U64), self.low, self.high, self.ones, self.zeros]

    @classmethod
    def view(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence whose arrays begin at byte `at` of a byte array, in place; and where it ends."""
        n, width, a, b = (int(x) for x in data[at : at + 32].view(U64))
        at += 32
        out = []
        for size, kind in ((a, U64), (b, U64), (b + 1, np.uint32), (b + 1, np.uint32)):
            end = at + size * np.dtype(kind).itemsize
            out.append(data[at:end].view(kind))
            at = (end + 7) & ~7
        return cls(n, width, *out), at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=U64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U64)
        out = self.low[word] >> shift
        over = (at & 63) + self.width > 64
        if over.any():
            out[over] |= self.low[word[over] + 1] << (U64(64) - shift[over])
        return out & U64((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = (word << 6) + _nth_one(self.high[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(U64) << U64(self.width)) | self._low(i)

    def _start(self, top: np.ndarray) -> np.ndarray:
        """How many values have high bits below `top`."""
        k = top - 1  # the zero that ends the bucket before
        word = np.searchsorted(self.zeros, np.maximum(k, 0), side="right") - 1
        place = (word << 6) + _nth_one(~self.high[word], np.maximum(k, 0) - self.zeros[word].astype(np.int64))
        return np.where(k < 0, 0, place - k)

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place not below the value, end of its bucket of equal high bits, low bits sought)."""
        values = np.asarray(values, dtype=U64)
        top, want = (values >> U64(self.width)).astype(np.int64), values & U64((1 << self.width) - 1)
        lo, end = self._start(top), self._start(top + 1)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo, end, want

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The first place whose value is not below each value (n if none)."""
        return self._search(values)[0]

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 where the sequence hasn't it. values below the universe."""
        at, end, want = self._search(values)
        ok = at < end
        ok[ok] = self._low(at[ok]) == want[ok]
        return np.where(ok, at, -1)


def to_bytes(parts: list[np.ndarray]) -> bytes:
    """Arrays one after the other, each padded to 8 bytes."""
    out = []
    for p in parts:
        raw = np.ascontiguousarray(p).tobytes()
        out.append(raw + b"\0" * (-len(raw) % 8))
    return b"".join(out)
