"""From code pairs to record pairs, where codes may repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import Layout
from ..plans.strategy import Strategy, strategy as make_strategy
from .codes import code_column, is_text, with_words, word_names
from .groups import word_counts
from .keys import shared_cells
from .pairs import word_pairs

# The records of a code are cut into parts of about this many.
HOT_ROWS = 100_000


def normal_code(df: DataFrame, b: int, code: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(x, *keep)`` with the code in the form ``pairs`` returns it."""
    layout = Layout(b)
    text = is_text(df, code) and not layout.narrow
    words = [F.col(w) for w in word_names(layout)]
    return with_words(df, code, layout).select(
        code_column(words, layout, text).alias("_x"), *keep
    ).withColumnRenamed("_x", "x")


def code_counts(df: DataFrame, b: int, code: str = "x") -> DataFrame:
    """``(x, n)``: how many records carry each code."""
    return normal_code(df, b, code).groupBy("x").agg(F.count(F.lit(1)).alias("n"))


def record_pair_counts(df: DataFrame, b: int, strategy: str | Strategy = "auto", *,
                       code: str = "x", partitions: int | None = None, **params) -> DataFrame:
    """``(x_lo, x_hi, n_lo, n_hi)``: the whole record result without writing it out.

    A code pair stands for ``n_lo * n_hi`` record pairs, a number that may grow
    with the square of the table.  Here one row stands for all of them.  Records
    are counted per code once, and the counts travel with the codes: no join.
    """
    s = strategy if isinstance(strategy, Strategy) else make_strategy(strategy, b, **params)
    layout, names = s.layout, word_names(s.layout)
    text = is_text(df, code) and not layout.narrow
    found = word_pairs(word_counts(df, s, code), s, partitions, count="n")
    lo, hi = ([F.col(f"{side}{w}") for w in names] for side in ("lo", "hi"))
    return found.select(code_column(lo, layout, text).alias("x_lo"), code_column(hi, layout, text).alias("x_hi"),
                        "n_lo", "n_hi")


def record_pairs(df: DataFrame, b: int, strategy: str | Strategy = "auto", *, code: str = "x",
                 id: str = "id", payload: Sequence[str] = (), mode: str = "distinct",
                 hot_rows: int = HOT_ROWS, **params) -> DataFrame:
    """``(id_a, id_b, x_a, x_b)`` for all records ``a``, ``b`` whose codes form a pair.

    ``payload`` columns come along as ``*_a`` and ``*_b``; otherwise only id and code are
    shuffled.  The records of a code are cut by a hash of the id into parts of about
    ``hot_rows``, one for most codes, and a pair of codes into the pairs of their parts.
    Either side of the last join is keyed by both codes and both parts, so that no key
    gathers more than a part of either.  In mode ``raw`` a pair of records comes once
    per cell in which it meets.
    """
    s = strategy if isinstance(strategy, Strategy) else make_strategy(strategy, b, **params)
    left, right, parts = record_sides(df, s, code, id, payload, mode, hot_rows)
    joined = left.join(right, parts)
    if "times" in joined.columns:
        joined = joined.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return joined.select(
        "id_a", "id_b", F.col("x_lo").alias("x_a"), F.col("x_hi").alias("x_b"),
        *[f"{c}_{name}" for c in payload for name in "ab"],
    )


def record_sides(df: DataFrame, s: Strategy, code: str, id: str, payload: Sequence[str],
                 mode: str, hot_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the last join of ``record_pairs``, and the columns they are joined on."""
    records = normal_code(df, s.b, code, [F.col(id).alias("id"), *payload])
    pairs_ = record_pair_counts(df, s.b, s, code=code)
    if mode == "raw" and not s.exactly_once:
        words = [[F.col(f"{x}{w}") for w in word_names(s.layout)] for x in ("_lo", "_hi")]
        pairs_ = _with_words_of(pairs_, s).withColumn("times", shared_cells(*words, s))
    elif mode not in ("distinct", "raw"):
        raise ValueError("mode is distinct or raw")

    def part_count(n: str):
        return F.ceil(F.col(n) / hot_rows).cast("int")

    def each(n: str):
        return F.explode(F.sequence(F.lit(0), part_count(n) - 1))

    times = ["times"] if "times" in pairs_.columns else []
    found = pairs_.withColumn("_part_a", each("n_lo")).withColumn("_part_b", each("n_hi")).select(
        "x_lo", "x_hi", "_part_a", "_part_b", *times)
    # Only codes of several parts are listed; the records of all others are part 0.
    many = code_counts(df, s.b, code).where(F.col("n") > hot_rows).select("x", part_count("n").alias("_parts"))
    cut = records.join(many, "x", "left").withColumn(
        "_part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    parts = ["x_lo", "x_hi", "_part_a", "_part_b"]

    def side(name: str, x: str, keep: list[str]) -> DataFrame:
        mine = cut.select(F.col("x").alias(x), F.col("_part").alias(f"_part_{name}"),
                          *[F.col(c).alias(f"{c}_{name}") for c in ("id", *payload)])
        return found.select(*parts, *keep).join(mine, [x, f"_part_{name}"])

    return side("a", "x_lo", times), side("b", "x_hi", []), parts


def _with_words_of(pairs_: DataFrame, s: Strategy) -> DataFrame:
    """The words of both codes of a pair."""
    for x, prefix in (("x_lo", "_lo"), ("x_hi", "_hi")):
        pairs_ = with_words(pairs_, x, s.layout).withColumnsRenamed({w: f"{prefix}{w}" for w in word_names(s.layout)})
    return pairs_
