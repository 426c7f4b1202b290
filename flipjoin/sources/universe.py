"""Generated input: all bitstrings of one length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import long_to_bits, pad_bits

# Fixed value: bytes a string object needs beside its characters, taken off
# the k * 1000 characters of a k-kilobyte payload.
STRING_OVERHEAD = 49


def payload_length(k: float) -> int:
    """Characters of a bitstring that is to take ``k`` kilobytes."""
    return int(k * 1000) - STRING_OVERHEAD


def bit_universe(spark: SparkSession, b: int, n: int | None = None,
                 payload: int | None = None) -> DataFrame:
    """The first ``n`` (default all) codes of ``b`` bits, ascending: ``(id, x, bits[, bitstring])``.

    ``payload`` is the length of the zero-padded ``bitstring``.  Rows are made
    on the executors.
    """
    if not 1 <= b <= 62:
        raise ValueError(f"b must lie in 1..62, got {b}")
    n = 1 << b if n is None else n
    if not 0 <= n <= 1 << b:
        raise ValueError(f"n must lie in 0..2^{b}, got {n}")
    df = spark.range(n).select("id", F.col("id").alias("x"), long_to_bits("id", b).alias("bits"))
    return df if payload is None else with_payload(df, b, payload)


def with_payload(df: DataFrame, b: int, payload: int, bits: str = "bits") -> DataFrame:
    """Add ``bitstring``: the bits, zero-padded to ``payload`` characters."""
    if payload < b:
        raise ValueError(f"a payload of {payload} characters cannot hold {b} bits")
    return df.withColumn("bitstring", pad_bits(bits, payload))
