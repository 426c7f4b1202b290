"""Suffix deduplication: depth-limited radix sort of suffixes, most significant digit first.

Suffixes are ordered only through their first ``length`` bytes; what is still equal
then are exactly the repeated windows.  Three digits are taken, each a pass that drops
what is already alone:

1. The first digit of a suffix is a gram of ``GRAM`` bytes within its window, at the
   place where grams hash smallest.  Equal windows have it at the same offset, and
   neighbouring suffixes mostly share the place, so one record (an anchor with the range
   of suffixes it leads) stands for up to ``length - GRAM + 1`` of them.
2. The second digit is the whole stretch that an anchor's windows cover.  Anchors whose
   stretch occurs twice are repeated as a whole.
3. Only anchors that are alone by the second digit but not by the first are sorted by
   single windows; stretches that occur often go there once.  Windows that a hash tells
   apart go; the others are ordered by content, eight bytes a pass from the first to the
   last, and what no pass has separated is equal (``equal_windows``).

Groups are counted by aggregates that combine before the shuffle.  A gram with very many
different stretches is dealt over several tasks, whose window counts are then added up;
there, and where a stretch occurs twice, equality is that of 128 bits of two hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, only_text, row_key, stored, text_bytes
from .numhash import Ranges, mix, text_groups

LENGTH = 200
GRAM = 48
#: Bytes of text that are looked at together.
SEGMENT = 2 << 20
#: Stretches of one gram that one task takes; of a gram with more, several tasks take a part each.
PART = 4096


def _sliding(x: np.ndarray, width: int, best: np.ufunc, fill) -> np.ndarray:
    """best of every ``width`` neighbours, from prefixes and suffixes of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n - width + 1], ahead[width - 1:n])


class Anchors:
    """The anchors of several texts.

    ``at`` is an anchor's place in the joined bytes, its suffixes start at
    ``first`` to ``last``, and ``gram`` and ``stretch`` are its two digits.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
        self.data = b"".join(texts)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        self.begin = ends - sizes
        n, width = len(self.data), length - gram + 1
        none = np.zeros(0, np.int64)
        self.at = self.first = self.last = self.text = none
        self.gram = self.stretch = none.astype(np.uint64)
        if n < length:
            return
        ranges = Ranges(self.data)
        starts = np.arange(n - gram + 1)
        grams = ranges.hash(starts, starts + gram)
        rank = (grams >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
        least = _sliding(rank, width, np.minimum, np.uint32(2**32 - 1))  # of the window at each start
        least[np.arange(len(least)) + length > np.repeat(ends, sizes)[:len(least)]] = 0  # crosses texts
        padded = np.zeros(len(rank) + width - 1, np.uint32)
        padded[width - 1:width - 1 + len(least)] = least
        self.at = np.flatnonzero(_sliding(padded, width, np.maximum, np.uint32(0)) == rank)
        # The suffixes of an anchor are the neighbours whose window has it as smallest.
        padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width, np.uint32)])
        view = np.lib.stride_tricks.sliding_window_view(padded, width)
        self.first, self.last = np.empty_like(self.at), np.empty_like(self.at)
        for i in range(0, len(self.at), 8192):
            at = self.at[i:i + 8192]
            own = view[at] == rank[at][:, None]
            self.first[i:i + 8192] = at - (width - 1) + own.argmax(axis=1)
            self.last[i:i + 8192] = at - own[:, ::-1].argmax(axis=1)
        self.gram = grams[self.at]
        self.text = np.searchsorted(ends, self.at, side="right")
        offset = (self.at - self.first).astype(np.uint64)
        self.stretch = mix(ranges.hash(self.first, self.last + length) + offset * np.uint64(0x9E3779B97F4A7C15))


def _anchor_rows(length: int):
    """(gram, stretch, row_key, place): place packs the start, the anchor's offset and the suffixes."""
    names = ["gram", "stretch", "row_key", "place"]

    def run(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            # Long texts in segments that share the last length - 1 bytes: each window is in one.
            cut = [(i, at) for i, t in enumerate(texts) for at in range(0, max(len(t) - length + 1, 1), SEGMENT)]
            row, base = np.array(cut, np.int64).reshape(-1, 2).T
            segments = [texts[i][at:at + SEGMENT + length - 1] if len(texts[i]) > SEGMENT else texts[i] for i, at in cut]
            for a, b in text_groups(segments, SEGMENT):
                x = Anchors(segments[a:b], length)
                place = (x.first - x.begin[x.text] + base[a:b][x.text]) << 16 | (x.at - x.first) << 8 | (x.last - x.first)
                columns = [x.gram.view(np.int64), x.stretch.view(np.int64), keys[row[a:b]][x.text], place]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return run


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """gram, stretch, row_key, place for each anchor of ``docs`` (row_key, text)."""
    return docs.mapInArrow(_anchor_rows(length), "gram long, stretch long, row_key long, place long")


def _stretches(length: int):
    """Bytes of the stretches listed with each document, to be sorted by windows."""
    names = ["gram", "parts", "row_key", "place", "many", "bytes"]

    def run(batches):
        for batch in batches:
            keys = batch.column("row_key").to_pylist()
            rows = []
            for key, text, units in zip(keys, text_bytes(batch.column("text")), batch.column("units").to_pylist()):
                for u in units:
                    start, more = u["place"] >> 16, u["place"] & 255
                    rows.append((u["gram"], u["parts"], key, u["place"], u["many"], text[start:start + more + length]))
            for i in range(0, len(rows), 20_000):
                columns = list(zip(*rows[i:i + 20_000]))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def window_hashes(blocks: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every window of the blocks, its block, and its start in there."""
    ranges = Ranges(b"".join(blocks))
    sizes = np.fromiter((len(b) for b in blocks), np.int64, len(blocks))
    per = sizes - length + 1
    block = np.repeat(np.arange(len(blocks)), per)
    inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = (np.cumsum(sizes) - sizes)[block] + inner
    return ranges.hash(start, start + length), block, inner


def equal_windows(data: np.ndarray, group: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Marks the windows that equal another one of their group, by most-significant-digit passes.

    A digit is eight bytes.  A group whose windows agree in it is left as it is, any other
    is sorted by it and falls into groups of its own; a window alone in its group is out.
    """
    order = np.argsort(group, kind="stable")
    group = group[order]
    words = np.lib.stride_tricks.as_strided(data[:max(len(data) - 7, 0)].view(), (max(len(data) - 7, 0), 8), (1, 1)) if len(data) > 7 else data.reshape(0, 8)

    def not_alone(g: np.ndarray) -> np.ndarray:
        same = g[1:] == g[:-1]
        return np.append(same, False) | np.append(False, same)

    keep = not_alone(group) if len(group) else np.zeros(0, bool)
    order, group = order[keep], group[keep]
    for at in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        if not len(order):
            break
        digit = np.ascontiguousarray(words[start[order] + at]).view(">u8").ravel().astype(np.uint64)
        apart = (group[1:] == group[:-1]) & (digit[1:] != digit[:-1])
        if not apart.any():
            continue
        number = np.cumsum(np.append(0, group[1:] != group[:-1]))
        mixed = np.zeros(number[-1] + 1, bool)
        mixed[number[1:][apart]] = True
        touched = np.flatnonzero(mixed[number])
        moved = touched[np.lexsort((digit[touched], number[touched]))]
        order[touched], digit[touched] = order[moved], digit[moved]  # number is the same along a group
        fresh = np.append(True, (number[1:] != number[:-1]) | (digit[1:] != digit[:-1]))
        group = np.cumsum(fresh)
        keep = not_alone(group)
        order, group = order[keep], group[keep]
    out = np.zeros(len(start), bool)
    out[order] = True
    return out


def _windows(length: int):
    """Window groups of sorted stretches.

    Of a gram within one task, the suffixes of lone stretches that another window
    equals, as (row_key, start, count of neighbours).  Of a gram in parts, every window
    as (key, row_key, start, many) for the global count.
    """
    names = ["key", "row_key", "start", "size", "many"]

    def of(rows, parts):
        gram, key, place, many, blocks = rows
        h, block, inner = window_hashes(blocks, length)
        offset = ((place >> 8) & 255)[block] - inner
        k = mix(h + gram.view(np.uint64)[block] + offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        start = (place >> 16)[block] + inner
        if parts:
            return [k.view(np.int64), key[block], start, np.ones(len(k), np.int64), many[block]]
        first = np.cumsum([0, *map(len, blocks)])[block] + inner
        same = equal_windows(np.frombuffer(b"".join(blocks), np.uint8), k, first, length)
        # What is marked in a lone stretch lies in runs: one row a run.
        mark = same & ~many[block]
        inside = np.zeros(len(k), bool)
        inside[1:] = block[1:] == block[:-1]
        head = mark & ~(np.append(False, mark[:-1]) & inside)
        run_of = np.cumsum(head) - 1
        size = np.bincount(run_of[mark], minlength=int(head.sum()))
        zero = np.zeros(len(size), np.int64)
        return [zero, key[block[head]], start[head], size, zero.astype(bool)]

    def run(batches):
        held: list = []
        size = 0

        def out(rows):
            columns = [np.concatenate(c) for c in zip(*(r[:5] for r in rows))]
            blocks = [b for r in rows for b in r[5]]
            gram, parts, key, place, many = columns
            for part in (False, True):
                chosen = np.flatnonzero((parts > 1) == part)
                for i in range(0, len(chosen), PART) if part else [0]:
                    c = chosen[i:i + PART] if part else chosen
                    if len(c):
                        found = of((gram[c], key[c], place[c], many[c], [blocks[j] for j in c]), part)
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in found], names=names)

        for batch in batches:
            arrays = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("gram", "parts", "row_key", "place", "many")]
            blocks = batch.column("bytes").to_pylist()
            cut = int(np.searchsorted(arrays[0], arrays[0][-1])) if len(blocks) else 0
            if len(blocks) and arrays[1][-1] > 1:  # its windows are counted globally
                cut = len(blocks)
            if cut and size + cut >= PART // 2:
                held.append([a[:cut] for a in arrays] + [blocks[:cut]])
                yield from out(held)
                held, size = [[a[cut:] for a in arrays] + [blocks[cut:]]], len(blocks) - cut
            elif len(blocks):
                held.append(arrays + [blocks])
                size += len(blocks)
        if held:
            yield from out(held)

    return run


def repeated_suffixes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row_key, start, size: runs of suffixes whose first ``length`` bytes occur again, stored.

    ``docs`` has row_key and text.  Rows that share a row_key count as so many texts.
    """
    found = stored(anchors(docs, length), "all-anchors")
    # First digit.  Both sides of the join are then dealt for it alone, so a hot gram can be split.
    grams = stored(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    again = stored(found.join(grams, "gram", "left_semi"), "anchors")
    discard(found, grams)
    # Second digit.
    by_stretch = again.groupBy("gram", "stretch").agg(F.count("*").alias("n"), F.min(F.struct("row_key", "place")).alias("one"))
    kinds = by_stretch.groupBy("gram").agg(F.count("*").alias("kinds"))
    digits = stored(by_stretch.join(kinds, "gram").select(
        "gram", "stretch", "kinds", (F.col("n") > 1).alias("many"), "one"), "digits")
    # Stretches to be sorted by windows: of grams with several, each once.
    parts = F.ceil(F.col("kinds") / PART).cast("int")
    open_ones = digits.filter("kinds > 1").select("one.row_key", F.struct("gram", parts.alias("parts"), "one.place", "many").alias("unit"))
    listed = open_ones.groupBy("row_key").agg(F.collect_list("unit").alias("units"))  # anchors of one document
    # A row_key that repeats only adds to windows that are repeated anyway.
    stretches = docs.join(listed, "row_key").select("row_key", "text", "units").mapInArrow(
        _stretches(length), "gram long, parts int, row_key long, place long, many boolean, bytes binary")
    salt = F.pmod(F.xxhash64("row_key", "place"), F.col("parts"))
    windows = stored(stretches.repartition(F.col("gram"), salt).sortWithinPartitions("gram").mapInArrow(
        _windows(length), "key long, row_key long, start long, size long, many boolean"), "windows")
    local = windows.filter("key = 0").select("row_key", "start", "size")
    split = windows.filter("key <> 0")
    counts = split.groupBy("key").agg((F.count("*") > 1).alias("again")).filter("again").select("key")
    wide = split.filter("not many").join(counts, "key").select("row_key", "start", F.lit(1).cast("long").alias("size"))
    whole = again.join(digits.filter("many").select("gram", "stretch"), ["gram", "stretch"]).select(
        "row_key", F.shiftright("place", 16).alias("start"), (F.col("place").bitwiseAND(255) + 1).alias("size"))
    runs = stored(whole.unionByName(local).unionByName(wide), "runs")
    discard(again, digits, windows)
    return runs


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of ``docs`` with n_bytes, removed (spans) and kept (bytes).

    Every byte covered by a string of ``length`` bytes that also starts anywhere else, in
    the same or another row, is removed; overlaps count, and strings are judged on the
    input.  ``removed`` lists the maximal removed runs as (start, end) in bytes, ``kept``
    is what is left.  A null text is empty; texts shorter than ``length`` stay whole;
    repeated rows repeat each other.  ``length`` is from 64 to 300.  Columns of ``docs``
    with one of the three names are replaced; an empty table gives an empty result.
    """
    if not GRAM + 16 <= length <= GRAM + 252:
        raise ValueError("length must be from 64 to 300")
    runs = repeated_suffixes(only_text(docs).select(row_key().alias("row_key"), "text"), length)
    listed = runs.groupBy(F.col("row_key").alias("__key")).agg(
        F.collect_list(F.struct("start", "size")).alias("__runs"))  # runs of one document
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.drop("n_bytes", "removed", "kept").withColumn(
        "__key", F.xxhash64(F.struct(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))))

    @F.pandas_udf("n_bytes long, starts array<long>, ends array<long>, kept binary")
    def cut(text: pd.Series, start: pd.Series, size: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cut_runs(t.encode(), s, n, length) for t, s, n in zip(text, start, size)],
                            columns=["n_bytes", "starts", "ends", "kept"])

    joined = rows.join(listed, "__key", "left").withColumn("__cut", cut(text, F.col("__runs.start"), F.col("__runs.size")))
    return joined.drop("__key", "__runs").withColumns({
        "n_bytes": F.col("__cut.n_bytes"),
        "removed": F.arrays_zip(F.col("__cut.starts").alias("start"), F.col("__cut.ends").alias("end")),
        "kept": F.col("__cut.kept"),
    }).drop("__cut")


def cut_runs(text: bytes, start, size, length: int) -> tuple[int, list[int], list[int], bytes]:
    if start is None or not len(start):
        return len(text), [], [], text
    order = np.argsort(start)
    begin = np.asarray(start, np.int64)[order]
    end = np.maximum.accumulate(begin + np.asarray(size, np.int64)[order] + (length - 1))
    new = np.append(True, begin[1:] > end[:-1])
    begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    edges = [0, *(x for pair in zip(begin.tolist(), end.tolist()) for x in pair), len(text)]
    return len(text), begin.tolist(), end.tolist(), b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
