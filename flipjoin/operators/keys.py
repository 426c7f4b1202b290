"""Key generators: which cells a code is sent to under each strategy."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import big, ones, shl, whole_division
from ..functions.layout import Layout
from ..plans.strategy import GROUP, HASHING, MAXPARALLEL, SERIAL, Strategy
from .codes import code_column, is_text, with_words, word_names


def block_of(words: list[Column], s: Strategy) -> Column:
    """The block of a code, a function of its value only.

    A value-based block gives the same answer when a lost task is run again,
    which a block taken from row placement would not.  ``placement`` is the
    partition a ``repartition(J, code)`` would put the code into.
    """
    how = {
        "hash": lambda: F.pmod(F.xxhash64(*words), big(s.param)),
        "mod": lambda: F.pmod(words[0], big(s.param)),
        "placement": lambda: F.pmod(F.hash(*words), F.lit(s.param)),
    }
    return how[s.block_by]().cast("int")


def grid_home(words: list[Column], s: Strategy) -> tuple[Column, Column]:
    """The home cell of a code on the half-weight grid, counted from 1."""
    half = s.b // 2

    def cell(weight: Column) -> Column:
        # the full weight joins the last cell instead of opening a new one
        return F.least(whole_division(weight, s.param) + 1, F.lit(half // s.param)).cast("int")

    left, right = _half_weights(words, s)
    return cell(left), cell(right)


def _half_weights(words: list[Column], s: Strategy) -> tuple[Column, Column]:
    half = s.b // 2
    return ones(words, s.layout, half, s.b), ones(words, s.layout, 0, half)


def grid_cells(words: list[Column], s: Strategy) -> list[Column]:
    """Home cell, then the lower neighbour cells of a code that sits on a border (else null).

    The diagonal cell is never needed: a pair at distance 1 changes one half only.
    """
    gi, gj = grid_home(words, s)
    left, right = _half_weights(words, s)

    def on_border(weight: Column, g: Column) -> Column:
        return (g > 1) & (weight == (g - 1) * s.param)

    def cell(i: Column, j: Column) -> Column:
        return F.struct(i.cast("int").alias("gi"), j.cast("int").alias("gj"))

    return [
        cell(gi, gj),
        F.when(on_border(left, gi), cell(gi - 1, gj)),
        F.when(on_border(right, gj), cell(gi, gj - 1)),
    ]


def emits(words: list[Column], s: Strategy) -> Column:
    """Cells a code is sent to, without generating them."""
    if s.name == SERIAL:
        n = F.lit(1)
    elif s.name == HASHING:
        n = F.lit(s.param)
    elif s.name == GROUP:
        n = reduce(add, (c.isNotNull().cast("int") for c in grid_cells(words, s)))
    else:
        n = F.lit(len(s.free_ranges))
    return n.cast("bigint")


def shared_cells(a: list[Column], c: list[Column], s: Strategy) -> Column:
    """Cells in which two codes at distance 1 meet."""
    if s.name == HASHING:
        n = F.when(block_of(a, s) == block_of(c, s), F.lit(s.param)).otherwise(F.lit(1))
    elif s.name == GROUP:
        both = [F.coalesce((p == q).cast("int"), F.lit(0))
                for p in grid_cells(a, s) for q in grid_cells(c, s)]
        n = reduce(add, both)
    else:
        n = F.lit(1)
    return n.cast("bigint")


CELL_FIELDS = {SERIAL: ["one"], HASHING: ["lo", "hi"], GROUP: ["gi", "gj"]}


def explode_cells(df: DataFrame, words: list[str], s: Strategy) -> DataFrame:
    """Add the ``CELL_FIELDS`` of the strategies whose cells span the whole code."""
    cols = [F.col(w) for w in words]
    if s.name == SERIAL:
        return df.withColumn("one", F.lit(1))
    if s.name == HASHING:
        df = df.withColumn("_i", block_of(cols, s))
        df = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(s.param - 1))))
        ends = {"lo": F.least("_i", "_j"), "hi": F.greatest("_i", "_j")}
        return df.withColumns(ends).drop("_i", "_j")
    if s.name == GROUP:
        df = df.withColumn("_cell", F.explode(F.array(*grid_cells(cols, s))))
        df = df.where(F.col("_cell").isNotNull())
        return df.withColumns({f: F.col("_cell")[f] for f in CELL_FIELDS[GROUP]}).drop("_cell")
    raise ValueError(f"{s.name} keys do not span the whole code")


def section_of(position: Column, s: Strategy) -> Column:
    """Number of the range of the strategy that holds a bit position."""
    number = {p: m for m, (low, high) in enumerate(s.free_ranges) for p in range(low, high)}
    return F.get(F.array(*[F.lit(number[p]) for p in range(s.b)]), position)


def pair_cells(lo: list[Column], hi: list[Column], s: Strategy, all_cells: bool) -> Column:
    """The cells (structs of ``CELL_FIELDS``) in which a pair meets, from its codes alone.

    An array: of all of them, or of the one that reports the pair.  For the strategies
    whose cells span the whole code.
    """
    if s.name == SERIAL:
        return F.array(F.struct(F.lit(1).alias("one")))
    if s.name == HASHING:
        i, j = block_of(lo, s), block_of(hi, s)

        def cell(x: Column, y: Column) -> Column:
            return F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))

        one = F.array(cell(i, j))
        if not all_cells:
            return one
        every = F.transform(F.sequence(F.lit(0), F.lit(s.param - 1)), lambda k: cell(i, k))
        return F.when(i == j, every).otherwise(one)
    if all_cells:
        mine, other = (F.array_compact(F.array(*grid_cells(w, s))) for w in (lo, hi))
        return F.array_intersect(mine, other)
    (li, lj), (ri, rj) = grid_home(lo, s), grid_home(hi, s)
    return F.array(F.struct(F.least(li, ri).alias("gi"), F.least(lj, rj).alias("gj")))


def masked_words(words: list[Column], n: Column, ranges: list[tuple[int, int]],
                 layout: Layout) -> list[Column]:
    """The words with range number ``n`` set to zero."""
    per_range = [layout.word_masks(low, high) for low, high in ranges]
    out = []
    for k, word in enumerate(words):
        keep = F.array(*[big(~masks[k]) for masks in per_range])
        out.append(word.bitwiseAND(F.get(keep, n)))
    return out


def section_key(words: list[Column], n: Column, s: Strategy, text: bool) -> Column:
    """Key of the strategies that mask a range: ``(p, masked)`` or ``(m, rest)``."""
    if s.name == MAXPARALLEL and s.layout.narrow:
        rest = words[0].bitwiseAND(F.bitwise_not(shl(big(1), n)))
    else:
        rest = code_column(masked_words(words, n, s.free_ranges, s.layout), s.layout, text)
    if s.name == MAXPARALLEL:
        return F.struct(n.cast("int").alias("p"), rest.alias("masked"))
    return F.struct(n.cast("int").alias("m"), rest.alias("rest"))


def keyed_words(df: DataFrame, s: Strategy, text: bool) -> DataFrame:
    """Add ``key`` to rows that carry the word columns, one row per cell."""
    names = word_names(s.layout)
    if s.name in CELL_FIELDS:
        fields = CELL_FIELDS[s.name]
        # the caller's columns may have the names of the fields
        own = df.select(F.struct(*df.columns).alias("_row"), *names)
        return explode_cells(own, names, s).select("_row.*", F.struct(*fields).alias("key"))
    words = [F.col(w) for w in names]
    last = len(s.free_ranges) - 1
    if text:  # formatted once a code; a cell whose range is zero anyway has the code itself
        df = df.withColumn("__text", code_column(words, s.layout, text))
    df = df.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(last))))
    key = _cut_key(words, F.col("_n"), s) if text else section_key(words, F.col("_n"), s, text)
    return df.withColumn("key", key).drop("_n", *(["__text"] if text else []))


def _cut_key(words: list[Column], n: Column, s: Strategy) -> Column:
    """``section_key`` of a text code, cut from ``__text``."""
    def at(values: list[int]) -> Column:
        return F.get(F.array(*map(F.lit, values)), n)

    ranges = s.free_ranges
    same = reduce(lambda a, c: a & c, (m == w for m, w in zip(masked_words(words, n, ranges, s.layout), words)))
    zeros = F.substr(F.lit("0" * max(high - low for low, high in ranges)), F.lit(1), at([high - low for low, high in ranges]))
    cut = F.concat(F.substr(F.col("__text"), F.lit(1), at([s.b - high for _, high in ranges])), zeros,
                   F.substr(F.col("__text"), at([s.b - low + 1 for low, _ in ranges]), at([low for low, _ in ranges])))
    rest = F.when(same, F.col("__text")).otherwise(cut)
    if s.name == MAXPARALLEL:
        return F.struct(n.cast("int").alias("p"), rest.alias("masked"))
    return F.struct(n.cast("int").alias("m"), rest.alias("rest"))


def keyed(df: DataFrame, s: Strategy, code: str = "x") -> DataFrame:
    """The map side: one row per record and cell, ``key`` first."""
    columns = df.columns
    text = is_text(df, code) and not s.layout.narrow
    return keyed_words(with_words(df, code, s.layout), s, text).select("key", *columns)
