"""Helpers that several operators share: tables, stored steps, row keys, batches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session

#: The white space of every contract: blank, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, two columns of them, a null text as the empty one."""
    return only_text(table(spark, sf_dir, "documents"))


def only_text(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the warehouse."""
    return session.shared_folder(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends here.

    A task that is lost later is run again from the written files.  The shuffle
    files of the step are no longer referenced and go with the next collection of
    the driver's garbage, which is asked for.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete stored steps that nothing will read again."""
    for df in steps:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One BIGINT for a row; rows equal in id and text share it and are treated alike."""
    return F.xxhash64(F.struct(F.col(doc_id), F.col(text)))


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def process_state() -> dict:
    """A dict of this Python process, which outlives the functions sent to it."""
    name = "_llm_process_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__.setdefault("state", {})


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``limit`` bytes of text, or one row."""
    for batch in batches:
        at, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(text)).to_pylist()
        for i, n in enumerate(lengths):
            if i > at and size + (n or 0) > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)
