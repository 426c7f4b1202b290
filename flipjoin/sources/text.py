"""Bitstrings as headerless two-column text: ``key,bitstrings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import bit_prefix, bits_to_long

SCHEMA = "key STRING, bitstrings STRING"


def read_bitstrings(spark: SparkSession, path: str, b: int, payload: bool = False) -> DataFrame:
    """Read ``(id, bits[, x][, bitstring])``; ``x`` only where ``b <= 63``.

    There is no header: the first line is data, with an empty key that stands
    for row 0.  Only the first ``b`` characters are significant; ``payload``
    keeps the rest as well.
    """
    raw = spark.read.csv(path, schema=SCHEMA, header=False, mode="FAILFAST")
    columns = [
        F.coalesce(F.col("key").cast("bigint"), F.lit(0)).cast("bigint").alias("id"),
        bit_prefix("bitstrings", b).alias("bits"),
    ]
    if b <= 63:
        columns.append(bits_to_long("bitstrings", b).alias("x"))
    if payload:
        columns.append(F.col("bitstrings").alias("bitstring"))
    return raw.select(*columns)


def scan_bitstrings(spark: SparkSession, path: str, b: int, payload: bool = False) -> tuple[DataFrame, DataFrame]:
    """``read_bitstrings`` and the lines it would fail on: ``(codes, rejects)``.

    ``rejects`` has line, reason and file.  A reason is ``fields`` (not two of them), ``key``
    (no whole number) or ``bits`` (not ``b`` characters 0 or 1 in front); the first that
    holds is given.  Every line of the file is in one of the two, an empty one among the
    rejects, and no line stops the scan.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    fields = F.split("line", ",", -1)
    key, bits = F.get(fields, F.lit(0)), F.get(fields, F.lit(1))
    number = F.when(key == "", F.lit(0)).otherwise(F.when(key.rlike("^[0-9]{1,18}$"), key.try_cast("bigint")))
    reason = (F.when(F.size(fields) != 2, "fields").when(number.isNull(), "key")
              .when(~bits.rlike(f"^[01]{{{b}}}"), "bits"))
    judged = lines.select("line", "file", fields.alias("fields"), number.alias("id"), reason.alias("reason"))
    good = judged.where(F.col("reason").isNull())
    text = F.col("fields")[1]
    columns = ["id", bit_prefix(text, b).alias("bits")]
    if b <= 63:
        columns.append(F.conv(bit_prefix(text, b), 2, 10).cast("bigint").alias("x"))
    if payload:
        columns.append(text.alias("bitstring"))
    return good.select(*columns), judged.where(F.col("reason").isNotNull()).select("line", "reason", "file")


def write_bitstrings(df: DataFrame, path: str, key: str = "id", bitstring: str = "bits",
                     mode: str = "errorifexists") -> None:
    """Write ``key,bitstring`` lines without a header; key 0 is left empty."""
    df.select(
        F.nullif(F.col(key), F.lit(0)).cast("string").alias("key"),
        F.col(bitstring).alias("bitstrings"),
    ).write.mode(mode).csv(path, header=False)
