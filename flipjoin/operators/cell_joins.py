"""The strategies run on their own cells: map, group and reduce as three steps.

``pairs`` finds all pairs by one slicing, whatever the strategy.  Here each strategy does
what it is named for, with its own replication and its own test of two codes:

serial, hashing  codes go to every pair of blocks with their own; a cell compares the codes
                 of one block with those of the other, by bitmaps of six bits.  Blocks can
                 be cut into sub-blocks, and pairs of those are the cells then.
group            codes go to their cell of the weight grid, and over its border.  A cell
                 compares bands: weight w of one half with w + 1, where the other half is
                 equal, by one bitmap for either weight.
maxparallel      codes go to b cells, by one bit masked; cells that count two codes are pairs.
multisection     codes meet those with equal rest in an equi-join, and differ in one bit of
                 the section that the rest leaves out.

A cell of serial, hashing and group may hold the whole table, so it is no task: its rows are
dealt by what lies outside a route of two slices, in which at most 2^12 codes are equal.
No step looks at a code twice to find out where it was: what decides whether a cell
reports a pair (its blocks, or whether the lower code is at home) travels with the row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import big, ones, shl, shr
from ..functions.layout import Slice
from ..plans.strategy import GROUP, HASHING, MAXPARALLEL, MULTISECTION, SERIAL, Strategy
from .cells import bitmap_pairs, lookup, slot_of
from .codes import word_names
from .keys import block_of, explode_cells, grid_home, masked_words

#: Slices that lie in one route: a shuffle key gets the codes that agree outside them, 2^12 at most.
ROUTE_SLICES = 2
#: Fields of a dealt row: a value in a route (12 bits), a side, the weight of a half and the route.
_VALUE, _SIDE, _WEIGHT, _ROUTE = 0, 12, 13, 33
#: Blocks of one strategy; as many counts come to the driver.
MOST_BLOCKS = 4096


def cut_blocks(codes: DataFrame, s: Strategy, cell_rows: int | None = None) -> list[int]:
    """Into how many sub-blocks each block is cut: one aggregated row a block, by a job of its own.

    Without ``cell_rows`` none is cut and no job runs.
    """
    blocks = s.param if s.name == HASHING else 1
    if blocks > MOST_BLOCKS:
        raise ValueError(f"cells of more than {MOST_BLOCKS} blocks are not run; use the slices")
    if cell_rows is None:
        return [1] * blocks
    counted = codes.groupBy(_block(s).alias("block")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["block"]: r["n"] for r in counted}
    return [max(1, -(-2 * sizes.get(k, 0) // cell_rows)) for k in range(blocks)]


def _block(s: Strategy) -> Column:
    return block_of([F.col(w) for w in word_names(s.layout)], s) if s.name == HASHING else F.lit(0)


def map_blocks(codes: DataFrame, s: Strategy, cuts: list[int]) -> DataFrame:
    """One row for each code and unit: (lo, hi) blocks, (ulo, uhi) units, side, words.

    Units are the sub-blocks, numbered through; where none is cut they are the blocks.
    """
    names = word_names(s.layout)
    first = [sum(cuts[:k]) for k in range(len(cuts))]
    owner = [k for k, n in enumerate(cuts) for _ in range(n)]
    block = F.col("_block")
    part = F.pmod(F.xxhash64(F.lit(17), *names), lookup(cuts, block, "bigint")).cast("int")
    mine, other = F.col("_unit"), F.col("_other")
    sent = codes.select(*names, _block(s).alias("_block")).select(*names, "_block", (lookup(first, block) + part).cast("int").alias("_unit")).select(
        *names, "_block", "_unit", F.explode(F.sequence(F.lit(0), F.lit(len(owner) - 1))).alias("_other"))
    theirs = lookup(owner, other).cast("int")
    return sent.select(F.least(block, theirs).alias("lo"), F.greatest(block, theirs).alias("hi"), F.least(mine, other).alias("ulo"),
                       F.greatest(mine, other).alias("uhi"), (mine > other).alias("upper"), *names)


def group_blocks(mapped: DataFrame, s: Strategy, partitions: int | None = None) -> DataFrame:
    """Bitmaps of the lower and of the upper unit for each cell, slice and rest.

    The shuffle is by cell and what lies outside a route, so no cell is one task; slices
    are taken and combined where their route is.
    """
    slices = s.layout.slices([(0, s.b)])
    # the one cell of serial is a constant, which is no shuffle key
    cells = ["_unit"] if s.name == SERIAL else ["_cell", "_unit"]
    packed = mapped.withColumns({"_cell": _both("lo", "hi"), "_unit": _both("ulo", "uhi")})
    upper = F.col("_side") == 1
    out = _dealt(packed, s, slices, cells, F.col("upper"), F.lit(0), partitions).groupBy(
        *cells, *_outside(s), "_at").agg(_bits(~upper).alias("low"), _bits(upper).alias("high"))
    if s.name == SERIAL:
        out = out.withColumn("_cell", big(0))
    return _placed(out, s, slices).select(*_halves("_cell", "lo", "hi"), *_halves("_unit", "ulo", "uhi"), "t", *word_names(s.layout), "low", "high")


def reduce_blocks(grouped: DataFrame, s: Strategy, raw: bool) -> DataFrame:
    """Pairs and the blocks of a cell that reports them.

    Two codes of one sub-block meet in its own cell, all others in the cell of their two.
    In mode ``raw`` two codes of one block are reported by all its cells.
    """
    names = word_names(s.layout)
    both = F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("z")), F.struct(F.col("high").alias("a"), F.col("low").alias("z")))
    own = F.array(F.struct(F.col("low").alias("a"), F.col("low").alias("z")))
    turned = grouped.withColumn("_side", F.explode(F.when(F.col("ulo") == F.col("uhi"), own).otherwise(both))).withColumns(
        {"low": F.col("_side.a"), "high": F.col("_side.z")})
    found = bitmap_pairs(turned, names, s.layout.slices([(0, s.b)]), "low", "high", ["lo", "hi"])
    if not raw or s.name == SERIAL:
        return found
    k = F.col("_k")
    every = F.sequence(F.lit(0), F.lit(s.param - 1))
    again = found.withColumn("_k", F.explode(F.when(F.col("lo") == F.col("hi"), every).otherwise(F.array("hi"))))
    return again.withColumns({"lo": F.least("lo", k), "hi": F.greatest("lo", k)}).drop("_k")


def map_grid(codes: DataFrame, s: Strategy) -> DataFrame:
    """One row for each code and cell of the weight grid: gi, gj, home, words."""
    names = word_names(s.layout)
    gi, gj = grid_home([F.col(w) for w in names], s)
    return explode_cells(codes.select(*names), names, s).withColumn("home", (F.col("gi") == gi) & (F.col("gj") == gj))


def group_grid(mapped: DataFrame, s: Strategy, raw: bool, partitions: int | None = None) -> DataFrame:
    """Bitmaps of the weights w and w + 1 for each cell, half, w, slice of that half and rest.

    The shuffle is by cell and what lies outside a route of a half, in which a pair is
    equal, so no cell of many codes is one task.  The lower code counts where it is at
    home, in mode ``raw`` everywhere.
    """
    names, half = word_names(s.layout), s.b // 2
    ranges = [(half, s.b), (0, half)]
    slices = s.layout.slices(ranges)
    words = [F.col(w) for w in names]
    left, right = ones(words, s.layout, half, s.b), ones(words, s.layout, 0, half)
    packed = mapped.withColumn("_cell", _both("gi", "gj"))
    dealt = _dealt(packed, s, slices, ["_cell"], F.col("home"), F.when(F.col("_half") == 0, left).otherwise(right), partitions)
    bands = dealt.withColumn("above", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
        "band", F.col("_weight") - F.col("above").cast("int"))
    lower = ~F.col("above") if raw else ~F.col("above") & (F.col("_side") == 1)
    out = bands.groupBy("_cell", *_outside(s), "_at", "band").agg(_bits(lower).alias("low"), _bits(F.col("above")).alias("high"))
    return _placed(out, s, slices).select(*_halves("_cell", "gi", "gj"), "band", "t", *names, "low", "high")


def reduce_grid(grouped: DataFrame, s: Strategy) -> DataFrame:
    """Pairs and the cell that found them."""
    slices = s.layout.slices([(s.b // 2, s.b), (0, s.b // 2)])
    return bitmap_pairs(grouped, word_names(s.layout), slices, "low", "high", ["gi", "gj"])


def map_masked(codes: DataFrame, s: Strategy) -> DataFrame:
    """One row for each code and bit: p and the words without it."""
    names = word_names(s.layout)
    numbered = codes.select(*names, F.explode(F.sequence(F.lit(0), F.lit(s.b - 1))).alias("p"))
    kept = masked_words([F.col(w) for w in names], F.col("p"), s.free_ranges, s.layout)
    return numbered.select("p", *[w.alias(f"_o{k}") for k, w in enumerate(kept)])


def group_masked(mapped: DataFrame, s: Strategy, partitions: int | None = None) -> DataFrame:
    """How many codes are equal without the bit: one or two.

    Rows are dealt before they are counted, as hardly two of a task fall together.
    """
    by = ["p", *[f"_o{k}" for k in range(len(word_names(s.layout)))]]
    return mapped.repartition(*([partitions] if partitions else []), *by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def reduce_masked(grouped: DataFrame, s: Strategy) -> DataFrame:
    """Cells of two codes: the one without the bit and the one with it."""
    p, names = F.col("p"), word_names(s.layout)
    at = [s.layout.word_of(i) for i in range(s.b)]
    lo, hi = [], []
    for k, w in enumerate(names):
        bit = lookup([1 << offset if word == k else 0 for word, offset in at], p, "bigint")
        lo.append(F.col(f"_o{k}").alias(f"lo{w}"))
        hi.append(F.col(f"_o{k}").bitwiseOR(bit).alias(f"hi{w}"))
    return grouped.where(F.col("n") == 2).select("p", *lo, *hi)


def map_sections(codes: DataFrame, s: Strategy) -> DataFrame:
    """One row for each code and section: m, the words without it, its own bits and their weight."""
    names = word_names(s.layout)
    numbered = codes.select(*names, F.explode(F.sequence(F.lit(0), F.lit(s.param - 1))).alias("m"))
    rest = masked_words([F.col(w) for w in names], F.col("m"), s.free_ranges, s.layout)
    parted = numbered.select("m", *[w.alias(f"_o{k}") for k, w in enumerate(rest)], *names).select(
        "m", *[f"_o{k}" for k in range(len(names))], *[F.col(w).bitwiseXOR(F.col(f"_o{k}")).alias(w) for k, w in enumerate(names)])
    return parted.withColumn("weight", reduce(add, (F.bit_count(w) for w in names)))


def group_sections(mapped: DataFrame, s: Strategy, partitions: int | None = None) -> DataFrame:
    """The rows dealt by cell.  ``cell_pairs`` leaves that to the join, which can split a large cell."""
    others = [f"_o{k}" for k in range(len(word_names(s.layout)))]
    return mapped.repartition(*([partitions] if partitions else []), "m", *others)


def reduce_sections(grouped: DataFrame, s: Strategy) -> DataFrame:
    """Codes of one cell whose sections differ in one bit: an equi-join of weights w and w + 1.

    The residual test sees the section alone; the rest is equal by the join.
    """
    names = word_names(s.layout)
    rest = [f"_o{k}" for k in range(len(names))]
    low = grouped.select("m", *rest, F.col("weight").alias("_band"), *[F.col(w).alias(f"_a{w}") for w in names])
    high = grouped.select("m", *rest, (F.col("weight") - 1).alias("_band"), *[F.col(w).alias(f"_z{w}") for w in names])
    apart = reduce(add, (F.bit_count(F.col(f"_a{w}").bitwiseXOR(F.col(f"_z{w}"))) for w in names))
    met = low.join(high, ["m", *rest, "_band"]).where(apart == 1)
    return met.select("m", *[F.col(f"_a{w}").bitwiseOR(F.col(f"_o{k}")).alias(f"lo{w}") for k, w in enumerate(names)],
                      *[F.col(f"_z{w}").bitwiseOR(F.col(f"_o{k}")).alias(f"hi{w}") for k, w in enumerate(names)])


def rows_per_code(s: Strategy) -> int:
    """Rows that a code becomes at most where cells are combined, for blocks that are not cut.

    Cells of maxparallel are entries of two hash tables (partial and final counts), each twice the row.
    """
    if s.name in (SERIAL, HASHING):
        return max(s.param, 1) * len(s.layout.slices([(0, s.b)]))
    if s.name == GROUP:  # three cells, two bands
        return 6 * len(s.layout.slices([(s.b // 2, s.b), (0, s.b // 2)]))
    return (4 if s.name == MAXPARALLEL else 1) * len(s.free_ranges)


def cell_steps(codes: DataFrame, s: Strategy, raw: bool, cell_rows: int | None = None, partitions: int | None = None) -> tuple:
    """The three steps of a strategy as functions: () to mapped, mapped to grouped, grouped to found.

    Each takes what the one before it gave, stored in between or not.
    """
    if s.name in (SERIAL, HASHING):
        cuts = cut_blocks(codes, s, cell_rows)
        return (lambda: map_blocks(codes, s, cuts), lambda df: group_blocks(df, s, partitions), lambda df: reduce_blocks(df, s, raw))
    if s.name == GROUP:
        return (lambda: map_grid(codes, s), lambda df: group_grid(df, s, raw, partitions), lambda df: reduce_grid(df, s))
    if s.name == MAXPARALLEL:
        return (lambda: map_masked(codes, s), lambda df: group_masked(df, s, partitions), lambda df: reduce_masked(df, s))
    return (lambda: map_sections(codes, s), lambda df: group_sections(df, s, partitions), lambda df: reduce_sections(df, s))


def cell_pairs(codes: DataFrame, s: Strategy, raw: bool, cell_rows: int | None = None, partitions: int | None = None) -> DataFrame:
    """lo words, hi words and the cell columns of every pair of the distinct ``codes`` (words)."""
    mapped, grouped, reduced = cell_steps(codes, s, raw, cell_rows, partitions)
    return reduced(mapped() if s.name == MULTISECTION else grouped(mapped()))


def _bits(where: Column) -> Column:
    return F.coalesce(F.bit_or(F.when(where, F.col("_bit"))), big(0))


def _routes(slices: list[Slice]) -> tuple[list[Slice], list[list[int]]]:
    """Neighbouring slices of one section and word together, and which slices each route has."""
    of: list[list[int]] = []
    for t, x in enumerate(slices):
        last = slices[of[-1][-1]] if of else None
        if last and len(of[-1]) < ROUTE_SLICES and (last.section, last.word, last.offset + last.width) == (x.section, x.word, x.offset):
            of[-1].append(t)
        else:
            of.append([t])
    firsts = [slices[ts[0]] for ts in of]
    return [Slice(x.section, x.word, x.offset, sum(slices[t].width for t in ts), x.position) for x, ts in zip(firsts, of)], of


def _outside(s: Strategy) -> list[str]:
    return [f"_o{k}" for k in range(len(word_names(s.layout)))]


def _dealt(df: DataFrame, s: Strategy, slices: list[Slice], cells: list[str], side: Column, weight: Column,
           partitions: int | None) -> DataFrame:
    """``df`` once for each slice, after a shuffle of one row for each route.

    ``cells`` and the words outside the route are the shuffle key; a key has at most 2^12
    codes.  ``_at`` is the slice and the route's value without it, ``_bit`` the value in
    the slice; ``_side`` and ``_weight`` come along.  ``weight`` may use ``_half``, the section.
    """
    names, others = word_names(s.layout), _outside(s)
    routes, of = _routes(slices)
    slot, rest = slot_of(names, routes)
    sent = df.select("*", F.explode(F.array(*map(F.lit, range(len(routes))))).alias("t"))
    sent = sent.withColumn("_half", lookup([x.section for x in routes], F.col("t")))
    fields = [(slot, _VALUE), (side.cast("bigint"), _SIDE), (weight.cast("bigint"), _WEIGHT), (F.col("t").cast("bigint"), _ROUTE)]
    row = reduce(Column.bitwiseOR, (shl(c, n) for c, n in fields))
    sent = sent.select(*cells, *[w.alias(o) for w, o in zip(rest, others)], row.alias("_row"))
    dealt = sent.repartition(*([partitions] if partitions else []), *cells, *others)

    def field(at: int, width: int) -> Column:
        return shr(F.col("_row"), at).bitwiseAND(big((1 << width) - 1))

    numbers = F.get(F.array(*[F.array(*map(F.lit, ts)) for ts in of]), field(_ROUTE, 30).cast("int"))
    t, value = F.col("_t"), F.col("_value")
    sliced = dealt.select(*cells, *others, field(_VALUE, 12).alias("_value"), field(_SIDE, 1).alias("_side"),
                          field(_WEIGHT, 20).cast("int").alias("_weight"), F.explode(numbers).alias("_t"))
    start = [x.offset - route.offset for route, ts in zip(routes, of) for x in (slices[t] for t in ts)]
    mask = lookup([((1 << x.width) - 1) << n for x, n in zip(slices, start)], t, "bigint")
    at = shl(t.cast("bigint"), _SIDE).bitwiseOR(value.bitwiseAND(F.bitwise_not(mask)))
    return sliced.select(*cells, *others, "_side", "_weight", at.alias("_at"),
                         shl(big(1), shr(value.bitwiseAND(mask), lookup(start, t))).alias("_bit"))


def _placed(grouped: DataFrame, s: Strategy, slices: list[Slice]) -> DataFrame:
    """The slice ``t`` and the words outside it, from ``_at`` and the words outside the route."""
    routes, of = _routes(slices)
    route = [x for x, ts in zip(routes, of) for _ in ts]
    t = F.col("t")
    value = shl(F.col("_at").bitwiseAND(big((1 << _SIDE) - 1)), lookup([x.offset for x in route], t))
    words = {w: F.col(o).bitwiseOR(value.bitwiseAND(lookup([-(x.word == k) for x in route], t, "bigint")))
             for k, (w, o) in enumerate(zip(word_names(s.layout), _outside(s)))}
    return grouped.withColumn("t", shr(F.col("_at"), _SIDE).cast("int")).withColumns(words)


def _both(high: str, low: str) -> Column:
    """Two non-negative numbers of 31 bits as one."""
    return shl(F.col(high).cast("bigint"), 32).bitwiseOR(F.col(low).cast("bigint"))


def _halves(both: str, high: str, low: str) -> list[Column]:
    return [shr(F.col(both), 32).cast("int").alias(high), F.col(both).bitwiseAND(big((1 << 32) - 1)).cast("int").alias(low)]
