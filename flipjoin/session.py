"""Session settings that suit these jobs, and the shared folder they may write to."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

# Rows are wide once a code is keyed, so aim below Spark's usual partition size.
PARTITION_BYTES = 128 << 20

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # small partitions are joined by hash instead of by sort
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # many small partitions, which adaptive execution merges to a good size
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "4096",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return builder


def shuffle_partitions(rows: int, replication: int, words: int = 1) -> int:
    """Shuffle partitions for ``rows`` codes keyed ``replication`` times.

    A shuffled row is a null word, the slice number, the code words and the
    bitmap, eight bytes each.  Give the result to ``spark.sql.shuffle.partitions``.
    """
    return max(1, math.ceil(rows * replication * 8 * (words + 3) / PARTITION_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """A folder every executor can reach.

    It is the one named by ``spark.checkpoint.dir``, otherwise the session's warehouse.  On a
    cluster a warehouse on the local disk is refused: each machine would see its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        local = not re.match("[a-z0-9]+:", folder) or folder.startswith("file:")
        if local and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back; ``discard`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*steps: DataFrame) -> None:
    """Delete stored steps that nothing will read again."""
    for df in steps:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
