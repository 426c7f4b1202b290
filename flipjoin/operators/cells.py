"""The reduce side: all distance-1 pairs without comparing the members of a cell.

Comparing all members of a cell costs the square of its size.  Here, for every
slice of at most six bits, codes that agree outside the slice share one BIGINT
bitmap of the slice values present.  The bitmap is a ``bit_or``, so

* a group is eight bytes however many rows feed it,
* a bitmap of distinct codes has at most 64 contributors, so no shuffle key is hot,
* no group is collected, and no candidates are compared row by row.

Two codes at distance 1 differ in one bit, hence in one slice, hence they meet
in exactly one bitmap.  In which cells of a strategy they meet follows from the two
codes (``keys.pair_cells``), so no code is repeated for each of its cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import big, shl, shr
from ..functions.layout import Slice


def _zero_bit_slots(p: int, width: int) -> int:
    """Bitmap of the slice values whose bit ``p`` is zero."""
    return sum(1 << value for value in range(1 << width) if not value >> p & 1)


def _has_pair(low: Column, high: Column, width: int) -> Column:
    """Whether a slot of ``high`` has one bit more than one of ``low``: one shift and two ANDs per bit."""
    hits = [
        low.bitwiseAND(shr(high, 1 << p)).bitwiseAND(big(_zero_bit_slots(p, width)))
        for p in range(width)
    ]
    return reduce(lambda a, c: a.bitwiseOR(c), hits) != 0


def lookup(values: list[int], t: Column, kind: str = "int") -> Column:
    """``values[t]``, folded to a literal where all values are the same."""
    if len(set(values)) == 1:
        return big(values[0]).cast(kind)
    return F.get(F.array(*[big(v).cast(kind) for v in values]), t)


def slot_of(words: list[str], slices: list[Slice]) -> tuple[Column, list[Column]]:
    """The value of slice ``t`` of the words, and the words outside it."""
    t = F.col("t")
    in_word = {
        w: lookup([s.mask if s.word == k else 0 for s in slices], t, "bigint")
        for k, w in enumerate(words)
    }
    chosen = reduce(lambda a, c: a.bitwiseOR(c),
                    (F.col(w).bitwiseAND(mask) for w, mask in in_word.items()))
    slot = shr(chosen, lookup([s.offset for s in slices], t))
    rest = [F.col(w).bitwiseAND(F.bitwise_not(mask)).alias(w) for w, mask in in_word.items()]
    return slot, rest


def slice_bitmaps(df: DataFrame, words: list[str], slices: list[Slice],
                  partitions: int | None = None, combine: bool = False,
                  count: str | None = None) -> DataFrame:
    """One row per slice and value outside the slice: ``(t, words, bitmap)``.

    Rows are shuffled before they are aggregated: a map-side combine finds little to
    combine among distinct codes in random order, and its hash table would hold every
    code once per slice.  ``combine`` is for input whose close codes lie together.
    With ``count``, a column of distinct codes, ``counts`` lists it by slot: a bitmap has
    64 slots, so the list is as bounded as the bitmap.
    """
    kept = [count] if count else []
    df = df.select(*words, *kept, F.explode(F.array(*map(F.lit, range(len(slices))))).alias("t"))
    slot, rest = slot_of(words, slices)
    by = ["t", *words]
    slotted = [F.struct(slot.cast("int").alias("slot"), F.col(count).alias("n")).alias("count")] if count else []
    sliced = df.select("t", *rest, shl(big(1), slot).alias("bitmap"), *slotted)
    if not combine:
        sliced = sliced.repartition(*([partitions] if partitions else []), *by)
    listed = [F.map_from_entries(F.collect_list("count")).alias("counts")] if count else []
    return sliced.groupBy(*by).agg(F.bit_or("bitmap").alias("bitmap"), *listed)


def bitmap_pairs(bitmaps: DataFrame, words: list[str], slices: list[Slice], low: str = "bitmap",
                 high: str = "bitmap", keep: Sequence[str] = ()) -> DataFrame:
    """Unfold bitmaps into ``(position, lo words, hi words)``, lo having the zero bit there.

    The lower code is of the bitmap ``low``, the other of ``high``.  Bitmaps with
    ``counts`` also give ``n_lo`` and ``n_hi``; columns in ``keep`` come along.
    """
    width = max(s.width for s in slices)
    t, i, p = F.col("t"), F.col("_i"), F.col("_p")

    def present(bitmap: str, slot: Column) -> Column:
        return shr(F.col(bitmap), slot).bitwiseAND(big(1)) == 1

    def numbers(n: int) -> Column:
        return F.explode(F.array(*map(F.lit, range(n))))

    hits = (
        bitmaps.where(_has_pair(F.col(low), F.col(high), width))
        .withColumn("_i", numbers(1 << width))
        .where(present(low, i))
        .withColumn("_p", numbers(width))
        .where((shr(i, p).bitwiseAND(F.lit(1)) == 0)
               & present(high, i.bitwiseOR(shl(F.lit(1), p))))
    )
    offset = lookup([s.offset for s in slices], t)
    value = shl(i.cast("bigint"), offset)
    flip = shl(big(1), offset + p)
    lo, hi = [], []
    for k, w in enumerate(words):
        mine = lookup([-(s.word == k) for s in slices], t, "bigint")
        x = F.col(w).bitwiseOR(value.bitwiseAND(mine))
        lo.append(x.alias(f"lo{w}"))
        hi.append(x.bitwiseOR(flip.bitwiseAND(mine)).alias(f"hi{w}"))
    position = (lookup([s.position for s in slices], t) + p).alias("position")
    counts = [F.col("counts")[i].alias("n_lo"), F.col("counts")[i.bitwiseOR(shl(F.lit(1), p))].alias("n_hi")] \
        if "counts" in bitmaps.columns else []
    return hits.select(position, *lo, *hi, *counts, *keep)
