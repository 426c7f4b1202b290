"""Code tables kept in the physical layout of their cells.

The distinct codes of a table are written once, one row for each section that a
multisection strategy leaves out, in buckets of the cell: the section and the rest.  A
join of such tables finds the rows of a cell in the same bucket and shuffles nothing,
whether a table is joined with itself or with another one in the same layout.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cell_joins import map_sections
from ..operators.codes import code_column, with_words, word_names
from ..plans.strategy import MULTISECTION, Strategy


def bucket_of(s: Strategy, buckets: int) -> Column:
    """The bucket of a row of a written table: where a ``repartition`` by its cell would put it."""
    return F.pmod(F.hash(*_cell(s)), F.lit(buckets)).cast("int")


def _cell(s: Strategy) -> list[str]:
    return ["m", *[f"_o{k}" for k in range(len(word_names(s.layout)))]]


def write_codes(df: DataFrame, s: Strategy, table: str, path: str, buckets: int, code: str = "x", mode: str = "errorifexists") -> None:
    """Write the distinct codes of ``df`` as ``table``, its files in ``path``, in ``buckets`` by cell.

    Rows are dealt by bucket first, so each bucket is one file.  Codes of more than 63
    bits are kept as words, like all others.
    """
    if s.name != MULTISECTION:
        raise ValueError("code tables are laid out by multisection")
    codes = with_words(df, code, s.layout).select(*word_names(s.layout)).distinct()
    mapped = map_sections(codes, s).repartition(buckets, *_cell(s))
    mapped.write.mode(mode).bucketBy(buckets, *_cell(s)).sortBy(*_cell(s)).option("path", path).saveAsTable(table)


def stored_pairs(spark: SparkSession, s: Strategy, table: str, other: str | None = None, text: bool = False) -> DataFrame:
    """``(x_lo, x_hi)`` of the codes of ``table``; with ``other``, ``(x, y)`` of a code in either.

    ``text`` gives codes as text, which those of more than 63 bits always are.
    """
    names, cell = word_names(s.layout), _cell(s)

    def side(name: str, prefix: str) -> DataFrame:
        return spark.table(name).select(*cell, F.col("weight").alias(f"{prefix}n"), *[F.col(w).alias(f"{prefix}{w}") for w in names])

    def code(prefix: str) -> Column:
        words = [F.col(f"{prefix}{w}").bitwiseOR(F.col(o)) for w, o in zip(names, cell[1:])]
        return code_column(words, s.layout, text or not s.layout.narrow)

    apart = reduce(add, (F.bit_count(F.col(f"_a{w}").bitwiseXOR(F.col(f"_z{w}"))) for w in names)) == 1
    # by the cell alone: it is what the buckets are of
    met = side(table, "_a").join(side(other or table, "_z"), cell).where(apart)
    if other is None:
        return met.where(F.col("_an") < F.col("_zn")).select(code("_a").alias("x_lo"), code("_z").alias("x_hi"))
    return met.select(code("_a").alias("x"), code("_z").alias("y"))
