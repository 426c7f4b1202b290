"""Periodic runs of words by online dyadic square catching.

Words are appended to a stream.  On level k every completed block of 2^k words gets a
catcher: it watches the next words for a second occurrence of its block, at a distance
(the period) that belongs to the level.  Each appended word ends one window of 2^k
words, whose hash is compared with the blocks whose watch covers it.  An occurrence
starts a comparison of the text with itself, shifted by the period: backwards over the
words before both, forwards with every appended word for as long as they agree.  The
squares it meets overlap and merge into one run, which is reported once it ends.

The runs looked for repeat a period q at least e times, so e - 1 times it agrees with
itself shifted by q; a level takes the periods for which such a stretch holds a whole
aligned block: 2 * 2^k - 1 <= (e - 1) * q.  So no run is missed, and a window is
compared with about 2 / (e - 1) blocks a level.  Any number of words can be appended
at once; the comparisons are then made in arrays, with the same outcome.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only_text, small_batches, text_bytes
from .numhash import mix

LEAST, EXPONENT = 6, 4
#: Bytes of text in one stream (or one text), words of one append to it, hashes compared at a time.
STREAM, STEP, COMPARED = 400_000, 1 << 18, 1 << 22


@dataclass
class Level:
    size: int                    # words of a block
    low: int                     # periods low .. high
    high: int
    blocks: dict[int, int] = field(default_factory=dict)  # start and hash of the watching ones


@dataclass
class Stretch:
    """Words start .. end - 1 agree with those a period before."""

    period: int
    start: int
    end: int


class SquareCatcher:
    """Catches the runs of a stream of numbers; ``longest`` bounds the length of a run."""

    def __init__(self, longest: int, least: int = LEAST, exponent: int = EXPONENT):
        if exponent < 2:
            raise ValueError("a run repeats its period at least twice")
        self.least, self.exponent = least, exponent
        self.words = np.zeros(1024, np.int64)
        self.n = 0
        self.live: dict[int, Stretch] = {}
        self.closed: dict[int, list[Stretch]] = {}  # by period, ends rising: what later windows may lie in
        self.tails: dict[int, np.ndarray] = {}      # by size, hashes of the last windows
        self.levels: list[Level] = []
        size, top = 1, longest // exponent
        while (low := -(-(2 * size - 1) // (exponent - 1))) <= top:
            high = min(-(-(4 * size - 1) // (exponent - 1)) - 1, top)
            if low <= high:
                self.levels.append(Level(size, low, high))
            size *= 2

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Take more words; (start, length, period) of the runs that ended."""
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:before], np.zeros(max(self.n, 2 * before) - before, np.int64)])
        self.words[before:self.n] = words
        ended = self._advance(before)
        fresh = mix(words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        size = 1  # ``fresh``: hashes of the windows of ``size`` words that end at the new ones
        for level in self.levels:
            while size < level.size:
                fresh, size = self._doubled(fresh, size), 2 * size
            self._catch(level, fresh, ended)
        return self._runs(ended)

    def finish(self) -> list[tuple[int, int, int]]:
        """The runs that reach to the last word."""
        ended, self.live = list(self.live.values()), {}
        return self._runs(ended)

    def _doubled(self, fresh: np.ndarray, size: int) -> np.ndarray:
        """Hashes of windows twice as long, from those of their halves."""
        held = np.concatenate([self.tails.get(size, np.zeros(0, np.uint64)), fresh])
        self.tails[size] = held[-size:]
        return mix(held[:-size] * np.uint64(0xA0761D6478BD642F) + held[size:])

    def _advance(self, before: int) -> list[Stretch]:
        """Every open comparison meets the new words."""
        ended = []
        for q, s in list(self.live.items()):
            s.end = self._forward(q, s.end)
            if s.end < self.n:
                ended.append(self.live.pop(q))
                self.closed.setdefault(q, []).append(s)
        reach = before - max((x.size for x in self.levels), default=0)
        for q in list(self.closed):  # no later window begins before ``reach``
            self.closed[q] = [s for s in self.closed[q] if s.end > reach]
            if not self.closed[q]:
                del self.closed[q]
        return ended

    def _catch(self, level: Level, fresh: np.ndarray, ended: list[Stretch]) -> None:
        size, low, high = level.size, level.low, level.high
        if not len(fresh):
            return
        end = self.n - size + 1          # windows begin at first .. end - 1
        first = end - len(fresh)
        blocks = level.blocks
        starts = np.arange(-(-first // size) * size, end, size)
        blocks.update(zip(starts.tolist(), fresh[starts - first].tolist()))
        for a in [a for a in blocks if a + high < first]:
            del blocks[a]                # their watch is over
        watched = np.array([a for a in blocks if a + low < end], np.int64)
        if not len(watched):
            return
        # a row for each block: the windows at the distances low .. high from it
        width = high - low + 1
        apart = np.zeros(width + size, np.uint64)
        row = np.lib.stride_tricks.sliding_window_view(np.concatenate([apart, fresh, apart]), width)
        at = watched + low - first + len(apart)
        mine = np.fromiter((blocks[a] for a in watched.tolist()), np.uint64, len(watched))
        step = max(1, COMPARED // width)
        for part in range(0, len(watched), step):
            rows = slice(part, part + step)
            which, far = np.nonzero(row[at[rows][0]:at[rows][-1] + 1:size] == mine[rows, None])
            if not len(which):
                continue
            period = far + low
            window = watched[rows][which] + period
            real = (window >= first) & (window < end)
            self._compare(period[real], window[real], size, ended)

    def _compare(self, period: np.ndarray, window: np.ndarray, size: int, ended: list[Stretch]) -> None:
        """Start the comparisons of new occurrences, smallest periods first."""
        order = np.lexsort((window, period))
        period, window = period[order], window[order]
        cuts = np.flatnonzero(np.diff(period)) + 1
        for q, at in zip(period[np.append(0, cuts)].tolist() if len(period) else [], np.split(window, cuts)):
            if q in self.live:
                at = at[at + size <= self.live[q].start]
            at = at[~self._within(q, at, size)]
            while len(at):
                t = int(at[0])
                end = self._forward(q, t)
                if end < t + size:       # equal hashes of different words
                    at = at[1:]
                    continue
                s = Stretch(q, self._backward(q, t), end)
                if end == self.n:
                    self.live[q] = s
                else:
                    ended.append(s)
                    self.closed.setdefault(q, []).append(s)
                    self.closed[q].sort(key=lambda x: x.start)
                at = at[at >= end]

    def _within(self, q: int, at: np.ndarray, size: int) -> np.ndarray:
        """Occurrences inside a stretch of the same period, or of one that divides it."""
        out = np.zeros(len(at), bool)
        for d in {*self.closed, *self.live}:
            if q % d:
                continue
            known = self.closed.get(d, []) + ([self.live[d]] if d in self.live else [])
            starts, ends = np.array([s.start for s in known]), np.array([s.end for s in known])
            k = np.searchsorted(starts, at - (q - d), "right") - 1
            out |= (k >= 0) & (ends[k] >= at + size) & (starts[k] <= at - (q - d))
        return out

    def _forward(self, q: int, at: int) -> int:
        """The first word from ``at`` on that differs from the one q before, or the end."""
        w, n, step = self.words, self.n, 64
        while at < n:
            to = min(at + step, n)
            differ = w[at:to] != w[at - q:to - q]
            if differ.any():
                return at + int(differ.argmax())
            at, step = to, min(2 * step, 1 << 20)
        return n

    def _backward(self, q: int, at: int) -> int:
        """The first word of the stretch that agrees up to ``at``."""
        w, step = self.words, 64
        while at > q:
            low = max(at - step, q)
            differ = w[low:at] != w[low - q:at - q]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = low, min(2 * step, 1 << 20)
        return at

    def _runs(self, ended: list[Stretch]) -> list[tuple[int, int, int]]:
        """Runs that are long enough; of the periods of one stretch of words the smallest."""
        best: dict[tuple[int, int], int] = {}
        for s in ended:
            start, length = s.start - s.period, s.end - s.start + s.period
            if length >= max(self.least, self.exponent * s.period):
                best[start, length] = min(s.period, best.get((start, length), s.period))
        return [(start, length, q) for (start, length), q in best.items()]


def runs_of(texts: list[list[bytes]], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period.

    The lists are appended to one stream; between two stands a number that no word has.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    number = {w: i for i, w in enumerate(set(chain.from_iterable(texts)))}
    catcher = SquareCatcher(int(lengths.max(initial=0)), least, exponent)
    found: list[tuple[int, int, int]] = []
    stream = chain.from_iterable(chain(map(number.__getitem__, words), (-1 - i,)) for i, words in enumerate(texts))
    while len(step := np.fromiter(islice(stream, STEP), np.int64)):
        found += catcher.append(step)
    found += catcher.finish()
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, q in sorted(found, key=lambda r: (r[0], r[2])):
        i = int(np.searchsorted(first, start, "right")) - 1
        out[i].append((start - int(first[i]), length, q))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: those in no run, or among the first period of each."""
    out, at = [], 0
    for a, b in sorted((s + q, s + n) for s, n, q in runs):
        if b > at:
            out += words[at:max(a, at)]
            at = b
    return out + words[at:]


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, runs (start, length, period) and collapsed for every row of ``docs``.

    A run is a stretch of words (runs of characters without white space) whose smallest
    period q repeats over max(``least``, ``exponent`` * q) words or more and that no word
    beside it continues.  ``runs`` is ordered by start, then period; starts count words
    from 0.  ``collapsed`` joins with one blank the words that are in no run, or within
    the first period of every run they are in.  A null or empty text has no run and
    collapses to the empty text; repeated rows each give a row, a null id stays null, an
    empty table gives an empty result, and no other column is read.  Texts are read whole.
    """
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", STREAM):
            words = [t.split() for t in text_bytes(batch.column("text"))]
            runs = runs_of(words, least, exponent)
            collapsed = [b" ".join(kept_words(w, r) if r else w) for w, r in zip(words, runs)]
            listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], pa.list_(run_type))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed, pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)

    return only_text(docs).mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
