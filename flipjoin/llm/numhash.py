"""Vectorised 64-bit hashes of byte ranges and words, over many texts at once.

A range hash is a polynomial in an odd base mod 2^64 over random byte values, so any
range comes from two prefix sums; ``mix`` spreads it over all bits.
"""

from __future__ import annotations

import numpy as np

from .common import process_state

BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept while n is usual."""
    state = process_state()
    held = state.get("powers")
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = tuple(out)
        if size <= 1 << 24:
            state["powers"] = held
    return held


class Ranges:
    """Hashes of byte ranges of one buffer."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, np.uint8)
        n = len(self.bytes)
        up, self.down = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = _byte_values()[self.bytes]
        terms *= up[:n]
        np.cumsum(terms, out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal ranges of equal length get equal hashes, wherever they are."""
        h = self.sums[end] - self.sums[start]
        h *= self.down[start]
        h += (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        return mix(h)


class Words:
    """The words of several texts: hash, start, end, and the text of each."""

    def __init__(self, texts: list[bytes]):
        self.n_texts = len(texts)
        data = b" ".join(texts).lower()  # bytes.lower changes A-Z only
        self.ranges = Ranges(data)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first_byte = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(texts) else np.zeros(0, np.int64)
        word = ~_SPACE[self.ranges.bytes]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = self.ranges.hash(self.start, self.end)
        #: Words of text i are first[i]:first[i + 1].
        self.first = np.append(np.searchsorted(self.start, self.first_byte), len(self.start))
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every run of ``width`` words; a shorter text is one run."""
        n = np.diff(self.first)
        h = self.hash
        state = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        factor = np.uint64(BASE)
        for k in range(width):
            state = state * factor + h[k:len(h) - width + 1 + k] if len(state) else state
        inside = self.text[:len(state)] == self.text[width - 1:] if len(state) else np.zeros(0, bool)
        short = np.flatnonzero((n > 0) & (n < width))
        more = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = n[short] > k
            more[has] = more[has] * factor + h[self.first[short[has]] + k]
        hashes = np.concatenate([mix(state[inside]), mix(more + n[short].astype(np.uint64))])
        return hashes, np.concatenate([self.text[:len(state)][inside], short])


def text_groups(texts, limit: int):
    """(from, to) of consecutive texts that hold about ``limit`` bytes, or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
