"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipjoin.llm import contamination, grace_dedup, packing, quality_knn, simhash_golay
from flipjoin.llm.common import discard, stored, table


def set_apart(docs: DataFrame) -> DataFrame:
    """The id, the text and one struct of all columns, whose names no operator replaces."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row"))


def put_back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as they came."""
    return rows.select("__row.*").select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote does not reject."""
    scored = quality_knn.quality_scores(set_apart(docs), table(spark, sf_dir, "labels"))
    return put_back(scored.filter("predicted = 1"), docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return grace_dedup.without_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each component of fingerprints at most two bits apart."""
    return simhash_golay.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    found = contamination.contamination(set_apart(docs), table(spark, sf_dir, "benchmark"))
    return put_back(found.filter("not contaminated"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its sequence and place there."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: No stage but the second can be said in SQL; tests compare run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
