"""Cells as groups: sizes, histograms and, where they are bounded, members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import big, shl, shr
from ..functions.layout import SLICE_BITS
from ..plans.strategy import MULTISECTION, Strategy
from .cells import lookup
from .codes import code_column, is_text, with_words, word_names
from .formatting import format_keys
from .keys import emits, keyed, keyed_words, masked_words, section_key

# Groups are shown as arrays only where the strategy bounds them by this.
LISTED_MEMBERS = 4096
# A cell of at most this many distinct codes needs no map-side sum.
SMALL_CELL = 65536
# Bits of neighbouring sections that are dealt by one row.
ROUTE_BITS = 12


def word_counts(df: DataFrame, s: Strategy, code: str = "x") -> DataFrame:
    """The word columns of every code and ``n``, its records."""
    names = word_names(s.layout)
    codes = with_words(df, code, s.layout)
    return codes.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))


def _routes(s: Strategy) -> list[list[int]]:
    """Neighbouring ranges of the strategy together, up to ``ROUTE_BITS`` bits or one range."""
    of: list[list[int]] = []
    for m, (low, high) in enumerate(s.free_ranges):
        width = sum(z - a for a, z in (s.free_ranges[k] for k in of[-1])) if of else 0
        if of and width + high - low <= ROUTE_BITS:
            of[-1].append(m)
        else:
            of.append([m])
    return of


def section_cells(codes: DataFrame, s: Strategy, keep: list[str], partitions: int | None = None) -> tuple[DataFrame, list[str]]:
    """One row for each code and cell of a strategy that masks a range, and the columns a cell is grouped by.

    ``_n`` is the range, ``_k`` the words without it.  A code is sent once for each route of
    neighbouring ranges, to where all codes are that agree outside the route, and gets its
    cells there; those columns are part of the cell's key, so no second shuffle follows.
    """
    names, of = word_names(s.layout), _routes(s)
    words = [F.col(w) for w in names]
    others, rest = ([f"{p}{k}" for k in range(len(names))] for p in ("_o", "_k"))
    spans = [(min(s.free_ranges[m][0] for m in ms), max(s.free_ranges[m][1] for m in ms)) for ms in of]
    sent = codes.select(*names, *keep, F.explode(F.array(*map(F.lit, range(len(of))))).alias("_r"))
    sent = sent.select(*names, *keep, "_r", *[w.alias(o) for w, o in zip(masked_words(words, F.col("_r"), spans, s.layout), others)])
    dealt = sent.repartition(*([partitions] if partitions else []), *others)
    numbers = F.get(F.array(*[F.array(*map(F.lit, ms)) for ms in of]), F.col("_r"))
    ranged = dealt.select(*names, *keep, *others, F.explode(numbers).alias("_n"))
    masked = masked_words(words, F.col("_n"), s.free_ranges, s.layout)
    return ranged.select(*names, *keep, *others, "_n", *[w.alias(k) for w, k in zip(masked, rest)]), [*others, "_n", *rest]


def _section_key(s: Strategy, text: bool) -> Column:
    return section_key([F.col(f"_k{k}") for k in range(len(s.layout.words))], F.col("_n"), s, text)


def cell_sizes(counts: DataFrame, s: Strategy, text: bool, partitions: int | None = None) -> DataFrame:
    """``(key, q)`` from counted codes.

    Few large cells are summed map-side first.  Many small ones would only fill
    the map-side hash table; with copies already counted, no such key is hot,
    so codes go to the shuffle by routes of ranges, and keys are formatted for whole cells.
    """
    if s.cell_bound and s.cell_bound <= SMALL_CELL:
        cells, by = section_cells(counts, s, ["n"], partitions)
        return cells.groupBy(*by).agg(F.sum("n").alias("q")).select(_section_key(s, text).alias("key"), "q")
    return keyed_words(counts, s, text).groupBy("key").agg(F.sum("n").alias("q"))


def group_sizes(df: DataFrame, s: Strategy, code: str = "x", partitions: int | None = None) -> DataFrame:
    """``(key, q)``: records per cell.  ``partitions`` sizes the shuffle of small cells."""
    text = is_text(df, code) and not s.layout.narrow
    return cell_sizes(word_counts(df, s, code), s, text, partitions)


def size_histogram(df: DataFrame, s: Strategy, code: str = "x") -> DataFrame:
    """``(q, n)``: how many cells have each size."""
    return group_sizes(df, s, code).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


def emits_histogram(df: DataFrame, s: Strategy, code: str = "x") -> DataFrame:
    """``(r, n)``: how many records are sent to ``r`` cells; no cell is generated for it."""
    words = [F.col(w) for w in word_names(s.layout)]
    rows = with_words(df, code, s.layout).select(emits(words, s).alias("r"))
    return rows.groupBy("r").agg(F.count(F.lit(1)).alias("n"))


def groups(df: DataFrame, s: Strategy, code: str = "x", partitions: int | None = None) -> DataFrame:
    """``(key, members)``: the distinct codes of every cell, sorted.

    A text is taken for its first ``b`` characters; up to 63 bits members are BIGINT.
    For strategies whose cells have a bound.  Elsewhere a cell may hold the whole
    table; ``keyed`` gives the same membership with one row per member.  Members of a
    section of up to six bits are a bitmap until they are listed.  ``partitions`` sizes the shuffle.
    """
    bound = s.cell_bound
    if bound is None or bound > LISTED_MEMBERS:
        raise ValueError(f"cells of {s.name} are not bounded by {LISTED_MEMBERS} members; use keyed")
    # the significant bits only: rows may carry padding
    text = is_text(df, code) and not s.layout.narrow
    words = [F.col(w) for w in word_names(s.layout)]
    if bound <= 1 << SLICE_BITS and all(sum(map(bool, s.layout.word_masks(*r))) == 1 for r in s.free_ranges):
        cells, by = section_cells(with_words(df, code, s.layout).select(*word_names(s.layout)).distinct(), s, [], partitions)
        start = lookup([s.layout.word_of(low)[1] for low, _ in s.free_ranges], F.col("_n"))
        own = reduce(Column.bitwiseOR, (w.bitwiseXOR(F.col(f"_k{k}")) for k, w in enumerate(words)))
        found = cells.groupBy(*by).agg(F.bit_or(shl(big(1), shr(own, start))).alias("_members"))
        keyed_cells = found.select("*", _section_key(s, text).alias("key"))
        return keyed_cells.select("key", _listed(s, text).alias("members"))
    codes = with_words(df, code, s.layout).select(code_column(words, s.layout, text).alias(code)).distinct()
    members = keyed(codes, s, code)
    return members.groupBy("key").agg(F.sort_array(F.collect_set(code)).alias("members"))


def _listed(s: Strategy, text: bool) -> Column:
    """The codes of a cell in order, from the bitmap ``_members`` of its section's values."""
    n, b, width = F.col("_n"), s.b, max(high - low for low, high in s.free_ranges)
    lows, highs = zip(*s.free_ranges)
    masked = F.col("key").getField("rest" if s.name == MULTISECTION else "masked")

    def member(v: int) -> Column:
        if not text:
            return masked.bitwiseOR(shl(big(v), lookup(list(lows), n)))
        wide = lookup([high - low for low, high in s.free_ranges], n)
        bits = F.substr(F.lit(format(v, f"0{width}b")), F.lit(width + 1) - wide, wide)
        return F.concat(F.substr(masked, F.lit(1), lookup([b - high for high in highs], n)), bits,
                        F.substr(masked, lookup([b - low + 1 for low in lows], n), lookup(list(lows), n)))

    present = [shr(F.col("_members"), v).bitwiseAND(big(1)) == 1 for v in range(1 << width)]
    return F.array_compact(F.array(*[F.when(here, member(v)) for v, here in enumerate(present)]))


def partition_sizes(df: DataFrame) -> DataFrame:
    """``(partition, n)``: rows per physical partition."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))


def key_volume(df: DataFrame, s: Strategy, code: str = "x") -> DataFrame:
    """``(keys, bytes, longest)``: how many keys the map side writes and the bytes of their text form.

    One row.  Codes are counted first, so a key is formatted once for all copies of its code.
    """
    text = is_text(df, code) and not s.layout.narrow
    formatted = format_keys(keyed_words(word_counts(df, s, code), s, text))
    size = F.octet_length("key").cast("bigint")
    zero = F.lit(0).cast("bigint")
    return formatted.agg(F.coalesce(F.sum("n"), zero).alias("keys"), F.coalesce(F.sum(size * F.col("n")), zero).alias("bytes"),
                         F.coalesce(F.max(size), zero).alias("longest"))
