"""Pairs as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import long_to_bits, pad_bits, section_text
from .codes import is_text

STYLES = ("plain", "reversed", "sections")


def format_pairs(df: DataFrame, b: int, style: str = "plain", *, payload: int | None = None,
                 section: int | None = None, result: str = "result") -> DataFrame:
    """Add ``result``: ``[lo,hi]``, ``[hi,lo]`` or the sections, each after a blank.

    ``payload`` pads both strings with zeros to that many characters (not for sections).
    """
    if style not in STYLES:
        raise ValueError(f"style is one of {', '.join(STYLES)}")
    if (style == "sections") != (section is not None):
        raise ValueError("section goes with style='sections'")
    if payload is not None and (style == "sections" or payload < b):
        raise ValueError("payload needs room for the bits and a style without sections")

    def shown(x: str) -> Column:
        bits = F.col(x) if is_text(df, x) else long_to_bits(x, b)
        if style == "sections":
            parts = [section_text(bits, b, section, m) for m in range(section)]
            return F.concat_ws(" ", F.lit(""), *parts)
        return bits if payload is None else pad_bits(bits, payload)

    first, second = ("x_hi", "x_lo") if style == "reversed" else ("x_lo", "x_hi")
    text = F.concat(F.lit("["), shown(first), F.lit(","), shown(second), F.lit("]"))
    return df.withColumn(result, text)


def format_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """Replace the fields of ``key`` by one text, separated by commas."""
    fields = [F.col(key)[f].cast("string") for f in df.schema[key].dataType.names]
    return df.withColumn(key, F.concat_ws(",", *fields))
