"""The similarity self-join: all pairs of codes that differ in exactly one bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.strategy import GROUP, HASHING, MAXPARALLEL, MULTISECTION, SERIAL, Strategy, strategy as make_strategy
from .cell_joins import cell_pairs
from .cells import bitmap_pairs, slice_bitmaps
from .codes import code_column, is_text, with_words, word_names
from .keys import pair_cells, section_key, section_of

#: Partitions of the large shuffle for each partition of the codes before it.
MAP_SHARE = 8


def pairs(
    df: DataFrame,
    b: int,
    strategy: str | Strategy = "auto",
    *,
    code: str = "x",
    mode: str = "distinct",
    with_key: bool = False,
    unique: bool = False,
    clustered: bool = False,
    partitions: int | None = None,
    execution: str = "slices",
    cell_rows: int | None = None,
    **params,
) -> DataFrame:
    """Pairs ``(x_lo, x_hi)`` of codes present in ``df``, ``x_lo`` having the zero bit.

    ``mode='distinct'`` gives every pair once.  ``mode='raw'`` gives it once per
    cell in which both codes meet, as a plain map/group/reduce run would.
    ``with_key`` adds the ``key`` of that cell.  Copies of a code count once; see
    ``record_pairs`` for pairs of records.  Text codes of more than 63 bits give text pairs.

    Codes are made distinct first, which melts copies before anything is
    multiplied; ``unique=True`` leaves that out where the code is a key of ``df``.
    ``clustered=True`` is for tables stored in the order of the code, such as running
    numbers: up to 64 codes then melt into one row before the only shuffle.  Either
    hint changes the speed only, never the pairs.  ``partitions`` sizes the large
    shuffle of unclustered codes (default: the session's setting).

    ``execution='slices'`` finds pairs by one slicing, whatever the strategy, and tells
    their cells from the codes.  ``'cells'`` runs the strategy on its own cells, with its
    own replication (see ``cell_joins``); the rows are the same.  With ``cell_rows`` blocks
    of serial and hashing are then cut where a cell would hold more codes, by counts that
    take a job while the query is built.  With ``partitions`` codes are dealt anew before
    they are replicated, so no task replicates a whole split.
    """
    if execution not in ("slices", "cells"):
        raise ValueError("execution is slices or cells")
    if mode not in ("distinct", "raw"):
        raise ValueError("mode is distinct or raw")
    s = strategy if isinstance(strategy, Strategy) else make_strategy(strategy, b, **params)
    if s.b != b:
        raise ValueError(f"the strategy is for {s.b} bits, not {b}")
    layout, names = s.layout, word_names(s.layout)
    text = is_text(df, code) and not layout.narrow

    codes = with_words(df, code, layout).select(*names)
    if not (unique or clustered):
        codes = codes.distinct()
    if execution == "cells":
        return _of_cells(codes.distinct() if clustered and not unique else codes, s, text, mode == "raw", with_key, cell_rows, partitions)
    found = word_pairs(codes, s, partitions, clustered)
    lo, hi = ([F.col(f"{side}{w}") for w in names] for side in ("lo", "hi"))
    out = [code_column(lo, layout, text).alias("x_lo"), code_column(hi, layout, text).alias("x_hi")]
    if s.name in (MAXPARALLEL, MULTISECTION):  # one cell each
        key = section_key(lo, section_of(F.col("position"), s), s, text)
        return found.select(*([key.alias("key")] if with_key else []), *out)
    if with_key or (mode == "raw" and not s.exactly_once):
        cells = F.explode(pair_cells(lo, hi, s, mode == "raw"))
        found = found.withColumn("key", cells)
    return found.select(*(["key"] if with_key else []), *out)


def _of_cells(codes: DataFrame, s: Strategy, text: bool, raw: bool, with_key: bool, cell_rows: int | None,
              partitions: int | None) -> DataFrame:
    if partitions:
        codes = codes.repartition(max(1, partitions // MAP_SHARE), *word_names(s.layout))
    found = cell_pairs(codes, s, raw, cell_rows, partitions)
    lo, hi = ([F.col(f"{side}{w}") for w in word_names(s.layout)] for side in ("lo", "hi"))
    keys = {
        SERIAL: lambda: F.struct(F.lit(1).alias("one")),
        HASHING: lambda: F.struct("lo", "hi"),
        GROUP: lambda: F.struct("gi", "gj"),
        MAXPARALLEL: lambda: section_key(lo, F.col("p"), s, text),
        MULTISECTION: lambda: section_key(lo, F.col("m"), s, text),
    }
    out = [code_column(lo, s.layout, text).alias("x_lo"), code_column(hi, s.layout, text).alias("x_hi")]
    return found.select(*([keys[s.name]().alias("key")] if with_key else []), *out)


def word_pairs(codes: DataFrame, s: Strategy, partitions: int | None = None,
               clustered: bool = False, count: str | None = None) -> DataFrame:
    """``(position, lo words, hi words)`` of every pair of distinct codes, once.

    The same for every strategy: a strategy says in which cells a pair meets, which its
    codes tell.  Each code is sent once per slice of six bits.
    """
    names = word_names(s.layout)
    slices = s.layout.slices([(0, s.b)])
    return bitmap_pairs(slice_bitmaps(codes, names, slices, partitions, clustered, count), names, slices)
