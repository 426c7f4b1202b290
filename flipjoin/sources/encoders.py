"""Codes from ordinary tables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import big, shl, words_to_text
from ..functions.layout import Layout


def fold_signs(vector: str, dims: int, b: int) -> Column:
    """``b`` sign bits of a whole vector: each bit is the sign of a run of components.

    Runs are summed from left to right as doubles; bit 0 of the vector becomes
    the leftmost bit of the code.
    """
    if b > 63 or dims % b:
        raise ValueError("b must divide the number of dimensions and be at most 63")
    run = dims // b
    item = [F.get(F.col(vector), F.lit(i)).cast("double") for i in range(dims)]
    bits = []
    for i in range(b):
        total = reduce(add, item[i * run:(i + 1) * run])
        bits.append(F.when(total > 0, big(1 << (b - 1 - i))).otherwise(big(0)))
    return reduce(add, bits)


def sign_text(vector: str, dims: int) -> Column:
    """One sign bit per component, as text; any number of dimensions."""
    return F.concat(*[
        F.when(F.get(F.col(vector), F.lit(i)) > 0, F.lit("1")).otherwise(F.lit("0"))
        for i in range(dims)
    ])


def text_digests(df: DataFrame, text: str, b: int = 16, code: str = "x") -> DataFrame:
    """Add the first ``b`` bits of the MD5 digest of a whole text; rows without text go.

    The code is typed as never null, so later null tests do not digest a text again.
    """
    if b % 4 or not 4 <= b <= 60:
        raise ValueError("b must be a multiple of 4 in 4..60")
    value = F.conv(F.substring(F.md5(F.col(text)), 1, b // 4), 16, 10).cast("bigint")
    return df.where(F.col(text).isNotNull()).withColumn(code, F.coalesce(value, big(0)))


def position_bitmap(df: DataFrame, by: str, position: Column, b: int, code: str = "x") -> DataFrame:
    """Per ``by``, the set of positions ``0 .. b-1`` seen, as a code (text beyond 63 bits).

    A ``bit_or`` per word: map-side combined, and the same size for any number of rows.
    """
    layout = Layout(b)
    bad = F.raise_error(F.concat(F.lit(f"position outside 0..{b - 1}: "), F.col("_pos").cast("string")))
    pos = F.when(F.col("_pos").isNull() | F.col("_pos").between(0, b - 1), F.col("_pos")).otherwise(bad)
    words = []
    for low, width in layout.words:
        bit = shl(big(1), F.col("_pos") - low)
        inside = F.col("_pos").between(low, low + width - 1)
        words.append(F.coalesce(F.bit_or(F.when(inside, bit)), big(0)))
    value = words[0] if layout.narrow else words_to_text(words, layout)
    return (
        df.select(by, position.cast("int").alias("_pos"))
        .withColumn("_pos", pos)
        .groupBy(by)
        .agg(value.alias(code))
    )


def bit_width(df: DataFrame, column: str) -> int:
    """Bits needed for the largest value of a non-negative column (one aggregated row)."""
    top = df.agg(F.max(column)).first()[0]
    return max(1, int(top or 0).bit_length())
