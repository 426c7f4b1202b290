"""A bounded sample of labelled documents, as many of either label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, only_text


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, mod: int, held_out: int) -> DataFrame:
    """text and y of at most ``per_label`` documents of each label, in an order by hash.

    Rows with crc32(doc_id as text) mod ``mod`` equal to ``held_out`` are never drawn.
    A document with several labels counts with the largest; labels other than 0 and 1
    and labels of no document are ignored.  Of rows that share a drawn id the least text
    is taken, so at most 2 * ``per_label`` rows are returned.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")) \
        .filter(F.col("y").isin(0, 1) & (crc_mod(F.col("doc_id"), mod) != held_out)) \
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    drawn = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        drawn = part if drawn is None else drawn.unionByName(part)
    # At most 2 * per_label ids: a size fixed by the parameter.
    return only_text(docs).join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
