"""What a strategy costs: replication, cell sizes and data volumes as one row."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.codes import is_text, with_words, word_names
from ..operators.groups import cell_sizes, word_counts
from ..operators.keys import emits, shared_cells
from ..operators.pairs import word_pairs
from .strategy import Strategy

COST_SCHEMA = (
    "strategy STRING, param INT, b INT, k INT, map_in BIGINT, map_out BIGINT, "
    "map_in_kb BIGINT, map_out_kb BIGINT, red_in_kb BIGINT, red_out_kb DECIMAL(38,0), "
    "q_max BIGINT, q_sum BIGINT, reducers BIGINT"
)


def cost_profile(df: DataFrame, s: Strategy, *, k: int = 1, key_volume: int = 0,
                 code: str = "x", unique: bool = False, partitions: int | None = None) -> DataFrame:
    """One row of costs for running ``s`` on the records of ``df``.

    ``k`` is the size of a record and ``key_volume`` that of a key, in KB.
    ``red_out_kb`` counts every emission, one per cell in which two records meet; it grows
    with the square of copies and is a DECIMAL.

    Records are first counted per code; every cost then follows from the codes
    and their counts.  ``unique=True`` skips that count where codes do not repeat;
    ``partitions`` sizes the shuffles of small cells and of emissions.
    Emissions are not enumerated: a pair is found once, by the cheapest
    strategy, and weighted with the number of cells its codes share.
    """
    names = word_names(s.layout)
    words = [F.col(w) for w in names]
    text = is_text(df, code) and not s.layout.narrow
    if unique:
        codes = with_words(df, code, s.layout).select(*names, F.lit(1).cast("bigint").alias("n"))
    else:
        codes = word_counts(df, s, code)

    n = F.col("n")
    mapped = codes.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("map_in"),
        F.coalesce(F.sum(n * emits(words, s)), F.lit(0)).alias("map_out"),
    )
    reduced = cell_sizes(codes, s, text, partitions).agg(
        F.coalesce(F.max("q"), F.lit(0)).alias("q_max"),
        F.coalesce(F.sum("q"), F.lit(0)).alias("q_sum"),
        F.count(F.lit(1)).alias("reducers"),
    )
    emitted = _emissions(codes, s, unique, partitions).agg(
        F.coalesce(F.sum("e"), F.lit(0)).cast("decimal(38,0)").alias("emitted")
    )
    # three one-row results become one row
    parts = mapped.unionByName(reduced, allowMissingColumns=True)
    parts = parts.unionByName(emitted, allowMissingColumns=True)
    row = parts.agg(*[F.max(c).alias(c) for c in parts.columns])
    volume = k + key_volume
    return row.select(
        F.lit(s.name).alias("strategy"),
        F.lit(s.param).alias("param"),
        F.lit(s.b).alias("b"),
        F.lit(k).alias("k"),
        "map_in",
        "map_out",
        (F.col("map_in") * k).alias("map_in_kb"),
        (F.col("map_out") * volume).alias("map_out_kb"),
        (F.col("q_sum") * volume).alias("red_in_kb"),
        (F.col("emitted") * (2 * k + key_volume)).cast("decimal(38,0)").alias("red_out_kb"),
        "q_max",
        "q_sum",
        "reducers",
    )


def _emissions(codes: DataFrame, s: Strategy, unique: bool, partitions: int | None = None) -> DataFrame:
    """``e`` per code pair: shared cells times record pairs, in exact decimals."""
    names = word_names(s.layout)
    # always true; a branch without ``n`` would count the records a second time
    # instead of sharing the shuffle of the counts
    found = word_pairs(codes.where(F.col("n") > 0), s, partitions, count=None if unique else "n")
    shared = shared_cells(*[[F.col(f"{side}{w}") for w in names] for side in ("lo", "hi")], s)
    if unique:
        return found.select(shared.cast("decimal(38,0)").alias("e"))
    exact = [F.col(c).cast("decimal(19,0)") for c in ("n_lo", "n_hi")]
    # 19 and 19 digits leave none for the third factor by type, but all do fit 38
    product = (exact[0] * exact[1]).cast("decimal(38,0)")
    return found.select((product * shared.cast("decimal(38,0)")).cast("decimal(38,0)").alias("e"))


def cost_profiles(df: DataFrame, strategies: Iterable[Strategy], **options) -> DataFrame:
    """One row per strategy."""
    return reduce(DataFrame.unionAll, (cost_profile(df, s, **options) for s in strategies))
