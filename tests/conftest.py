import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flipjoin import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")) + "/")
    )
    session = configure(builder).config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "8").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def universe(spark):
    from flipjoin import bit_universe

    return bit_universe(spark, 8).cache()


def codes_frame(spark, values, text=False):
    kind = "STRING" if text else "BIGINT"
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id BIGINT, x {kind}")


def brute(values):
    """All pairs of distinct codes at distance 1, by comparing every two."""
    codes = sorted(set(values))
    return {(x, y) for i, x in enumerate(codes) for y in codes[i + 1:] if (x ^ y).bit_count() == 1}


def as_pairs(df):
    rows = [(r.x_lo, r.x_hi) for r in df.select("x_lo", "x_hi").collect()]
    assert len(rows) == len(set(rows)), "a pair was reported twice"
    return set(rows)
