"""Column functions on bitstrings and on their BIGINT form.

Everything here is a composition of Spark built-ins, so it stays inside
whole-stage code generation and never starts a Python worker.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import Layout, section_ranges


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def big(value: int) -> Column:
    """A BIGINT literal; values from 2^63 on wrap to their two's complement."""
    value &= (1 << 64) - 1
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("bigint")


def shl(value: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.call_function("shiftleft", value, n.cast("int"))


def shr(value: Column, n: Column | int) -> Column:
    """Logical (zero-filling) shift right."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.call_function("shiftrightunsigned", value, n.cast("int"))


# -- text form ------------------------------------------------------------

def bit_prefix(text: Column | str, b: int) -> Column:
    """The ``b`` significant characters of a padded bitstring."""
    return F.substring(_col(text), 1, b)


def pad_bits(bits: Column | str, length: int) -> Column:
    """Zero-pad on the right to ``length`` characters (the payload form)."""
    return F.rpad(_col(bits), length, "0")


def byte_length(text: Column | str) -> Column:
    """UTF-8 byte length."""
    return F.octet_length(_col(text)).cast("bigint")


def long_to_bits(x: Column | str, b: int) -> Column:
    return F.lpad(F.bin(_col(x)), b, "0")


def bits_to_long(text: Column | str, b: int) -> Column:
    """BIGINT value of the first ``b <= 63`` characters; fails on anything but 0 and 1."""
    if b > 63:
        raise ValueError("a BIGINT holds at most 63 bits; use text_to_words")
    return _parse_bits(_checked(text, b), 1, b)


def text_to_words(text: Column | str, layout: Layout) -> list[Column]:
    """The words of a text code, lowest word first."""
    checked = _checked(text, layout.b)
    return [
        _parse_bits(checked, layout.b - low - width + 1, width) for low, width in layout.words
    ]


def words_to_text(words: list[Column], layout: Layout) -> Column:
    parts = [F.lpad(F.bin(w), width, "0") for w, (_, width) in zip(words, layout.words)]
    return F.concat(*reversed(parts))


def _checked(text: Column | str, b: int) -> Column:
    text = _col(text)
    bad = F.raise_error(F.concat(F.lit(f"not a bitstring of at least {b} bits: "), text))
    return F.when(text.isNull() | text.rlike(f"^[01]{{{b}}}"), text).otherwise(bad)


def _parse_bits(text: Column, start: int, width: int) -> Column:
    return F.conv(F.substring(text, start, width), 2, 10).cast("bigint")


def whole_division(value: Column, by: int) -> Column:
    return F.call_function("div", value, F.lit(by))


# -- bit arithmetic -------------------------------------------------------

def flip_bit(x: Column | str, p: Column | int) -> Column:
    return _col(x).bitwiseXOR(shl(big(1), p))


def clear_bit(x: Column | str, p: Column | int) -> Column:
    return _col(x).bitwiseAND(F.bitwise_not(shl(big(1), p)))


def hamming(x: Column | str, y: Column | str) -> Column:
    """Number of differing bits of two BIGINT codes."""
    return F.bit_count(_col(x).bitwiseXOR(_col(y)))


def words_hamming(x: list[Column], y: list[Column]) -> Column:
    return reduce(add, (hamming(a, c) for a, c in zip(x, y)))


def text_hamming(a: Column | str, c: Column | str, b: int) -> Column:
    """Number of differing bits of two text codes of any width."""
    layout = Layout(b)
    return words_hamming(text_to_words(a, layout), text_to_words(c, layout))


def is_neighbour(x: Column | str, y: Column | str) -> Column:
    """Distance exactly one, by an integer test (no rounding at any ``b``)."""
    return hamming(x, y) == 1


def is_section_neighbour(x: Column | str, y: Column | str, b: int, section: int, m: int) -> Column:
    """Distance exactly one when only section ``m`` is compared."""
    return hamming(section_value(x, b, section, m), section_value(y, b, section, m)) == 1


def section_value(x: Column | str, b: int, section: int, m: int) -> Column:
    low, high = section_ranges(b, section)[m]
    return shr(_col(x), low).bitwiseAND(big((1 << (high - low)) - 1))


def drop_section(x: Column | str, b: int, section: int, m: int) -> Column:
    """The code with section ``m`` set to zero."""
    low, high = section_ranges(b, section)[m]
    return _col(x).bitwiseAND(big(~((1 << high) - (1 << low))))


def section_text(text: Column | str, b: int, section: int, m: int) -> Column:
    low, high = section_ranges(b, section)[m]
    return F.substring(_col(text), b - high + 1, high - low)


def drop_section_text(text: Column | str, b: int, section: int, m: int) -> Column:
    """The text with section ``m`` cut out."""
    low, high = section_ranges(b, section)[m]
    text = _col(text)
    return F.concat(F.substring(text, 1, b - high), F.substring(text, b - low + 1, low))


def ones(words: list[Column], layout: Layout, low: int, high: int) -> Column:
    """Number of ones at positions ``low <= position < high``."""
    counts = [
        F.bit_count(w.bitwiseAND(big(mask)))
        for w, mask in zip(words, layout.word_masks(low, high))
        if mask
    ]
    return reduce(add, counts)


def half_weights(x: Column | str, b: int) -> tuple[Column, Column]:
    """Ones in the left and in the right half of a BIGINT code."""
    layout = Layout(b)
    return ones([_col(x)], layout, b // 2, b), ones([_col(x)], layout, 0, b // 2)


def text_ones(text: Column | str) -> Column:
    """Number of ones in a text code."""
    return F.length(F.replace(_col(text), F.lit("0"), F.lit(""))).cast("int")


def unordered(x: Column | str, y: Column | str) -> Column:
    """A pair as a key that does not depend on the order of its members."""
    return F.struct(F.least(_col(x), _col(y)).alias("lo"), F.greatest(_col(x), _col(y)).alias("hi"))
