"""From a user's code column to BIGINT words and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bits import big, text_to_words, words_to_text
from ..functions.layout import Layout


def is_text(df: DataFrame, code: str) -> bool:
    return isinstance(df.schema[code].dataType, T.StringType)


def word_names(layout: Layout, prefix: str = "_w") -> list[str]:
    return [f"{prefix}{k}" for k in range(len(layout.words))]


def with_words(df: DataFrame, code: str, layout: Layout) -> DataFrame:
    """Add the word columns of ``code``; rows without a code have no pairs and go.

    A BIGINT outside ``0 .. 2^b - 1`` and a text that does not start with ``b``
    characters 0 or 1 fail the query instead of giving silent nonsense.
    """
    df = df.where(F.col(code).isNotNull())
    if is_text(df, code):
        words = text_to_words(code, layout)
    else:
        if not layout.narrow:
            raise ValueError("codes of more than 63 bits are given as text")
        x = F.col(code).cast("bigint")
        bad = F.raise_error(F.concat(F.lit(f"not a {layout.b}-bit code: "), x.cast("string")))
        words = [F.when(x.between(big(0), big((1 << layout.b) - 1)), x).otherwise(bad)]
    # Never null by type, so no join or filter tests for null again.  Such a test
    # would be pushed below and evaluate the code a second time, and it would keep
    # Spark from sharing a shuffle between branches that have it and those that do not.
    known = [F.coalesce(w, big(0)) for w in words]
    return df.withColumns(dict(zip(word_names(layout), known)))


def code_column(words: list[Column], layout: Layout, text: bool) -> Column:
    """The words in the form the user gave: BIGINT or text."""
    return words_to_text(words, layout) if text else words[0]

