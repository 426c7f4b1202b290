"""Elias-Fano coded monotone sequences in numpy, and blobs of arrays that are mapped in place."""

from __future__ import annotations

import json
import mmap
import zlib

import numpy as np

#: Begins a blob in a file (fixed value).
MAGIC = bytes.fromhex("e7a1f0c35b9d4286930f7ce2d4186ab9")
#: Low bits that lie unpacked at a time, 17 bytes each.
UNPACKED = 1 << 20


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers in about log2(universe / n) + 2 bits each.

    The low bits lie packed; the high bits are a bit vector with a one for each number
    and a zero after each bucket of equal high bits, and a directory of its zeros.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays
        self.n, self.width, self.top = (int(x) for x in arrays["shape"])
        low = arrays["low"]
        self.low = np.ndarray((max(len(low) - 7, 0),), "<u8", low, strides=(1,)) if len(low) > 7 else np.zeros(0, np.uint64)
        self.high, self.zeros = arrays["high"], arrays["zeros"]

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        largest = int(values[-1]) if n else 0
        width = min(max((largest // max(n, 1)).bit_length() - 1, 0), 56)
        top = largest >> width
        bits = np.zeros(-(-(n + top + 2) // 64) * 64, np.uint8)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        zeros = np.cumsum(64 - np.bitwise_count(high).astype(np.int64))
        low = np.zeros(0, np.uint8)
        if width:
            step = max(1, UNPACKED // width) // 8 * 8 or 8
            parts = [np.packbits(((values[i:i + step, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
                     for i in range(0, n, step)]
            low = np.concatenate([*parts, np.zeros(8, np.uint8)])
        return cls({"shape": np.array([n, width, top], np.int64), "low": low, "high": high, "zeros": zeros})

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """Place of the zero of each rank, from 0."""
        word = np.searchsorted(self.zeros, rank, side="right")
        left = rank - np.where(word > 0, self.zeros[np.maximum(word - 1, 0)], 0)
        rest = ~self.high[word]
        place = np.zeros(len(rank), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            below = rest & np.uint64((1 << half) - 1)
            count = np.bitwise_count(below).astype(np.int64)
            skip = left >= count
            left = np.where(skip, left - count, left)
            place += half * skip
            rest = np.where(skip, rest >> np.uint64(half), below)
        return word * 64 + place

    def bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end index of the numbers with these high bits; high is at most top."""
        after = self._zero(np.maximum(high - 1, 0)) - (high - 1)
        return np.where(high > 0, after, 0), self._zero(high) - high

    def low_bits(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), np.uint64)
        bit = index * self.width
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def successor(self, values: np.ndarray, first=None, end=None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first number not below each value, and whether it is equal.

        Looked for from ``first`` to ``end`` (indices) where they are given; where there
        is none the index is not meaningful and equal is false.
        """
        values = values.astype(np.uint64)
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        inside = high <= self.top
        lo, hi = self.bucket(np.minimum(high, self.top))
        if first is not None:
            lo, hi = np.maximum(lo, first), np.minimum(hi, end)
        stop = hi
        want = values & np.uint64((1 << self.width) - 1)
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.low_bits(mid) < want[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi = hi.copy()
            hi[open_] = np.where(below, hi[open_], mid)
        found = inside & (lo < stop)
        at = np.minimum(lo, self.n - 1)
        return lo, found & (self.low_bits(at) == want)

    def access(self, index: np.ndarray) -> np.ndarray:
        """The numbers at sorted or unsorted indices."""
        ones = 64 * (np.arange(len(self.zeros)) + 1) - self.zeros
        word = np.searchsorted(ones, index, side="right")
        left = index - np.where(word > 0, ones[np.maximum(word - 1, 0)], 0)
        rest = self.high[word]
        place = np.zeros(len(index), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            below = rest & np.uint64((1 << half) - 1)
            count = np.bitwise_count(below).astype(np.int64)
            skip = left >= count
            left = np.where(skip, left - count, left)
            place += half * skip
            rest = np.where(skip, rest >> np.uint64(half), below)
        high = (word * 64 + place - index).astype(np.uint64)
        return (high << np.uint64(self.width)) | self.low_bits(index)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """A blob of named arrays: marker, sizes of its head and body, checksum of the head, both."""
    entries, parts, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        entries[name] = [a.dtype.str, len(a), at]
        parts += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    head = json.dumps(entries).encode()
    return b"".join([MAGIC, *(x.to_bytes(8, "little") for x in (len(head), at, zlib.crc32(head))), head, *parts])


def packed(blob: bytes) -> dict[str, np.ndarray]:
    """The arrays of one blob in memory."""
    return next(_blobs(blob))


def mapped(path: str):
    """The arrays of every blob of a file, mapped: only pages that are read come into memory.

    A marker without its blob, as in the statistics of a file, is passed over.
    """
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    yield from _blobs(data)


def _blobs(data):
    at = data.find(MAGIC)
    while at >= 0:
        start = at + len(MAGIC) + 24
        if start <= len(data):
            head, size, check = (int(x) for x in np.frombuffer(data, "<u8", 3, at + len(MAGIC)))
            if start + head + size <= len(data) and zlib.crc32(data[start:start + head]) == check:
                entries = json.loads(data[start:start + head])
                yield {name: np.frombuffer(data, kind, n, start + head + where) for name, (kind, n, where) in entries.items()}
                at = start + head + size - 1
        at = data.find(MAGIC, at + 1)


def prefixed(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": a for k, a in ef.arrays.items()}


def coded(name: str, arrays: dict[str, np.ndarray]) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in ("shape", "low", "high", "zeros")})
