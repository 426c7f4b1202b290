"""Plans stay inside the JVM, compare no two rows of a cell, and read one column."""

import re

import pytest
from conftest import as_pairs, brute

from flipjoin import cost_profile, pairs, record_pair_counts, record_pairs, strategy

KINDS = [("serial", {}), ("hashing", {"J": 4}), ("group", {"u": 2}), ("maxparallel", {}),
         ("multisection", {"section": 4}), ("auto", {})]
FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin",
             "SinglePartition")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("codes") / "t.parquet")
    df = spark.range(2000).selectExpr("id", "id * 7 % 4096 AS x", "repeat('z', 100) AS payload")
    df.write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name,params", KINDS)
def test_pairs_plan(table, name, params):
    df = pairs(table, 12, name, **params)
    text = plan(df)
    assert not [word for word in FORBIDDEN if word in text]
    assert "Join" not in text and "collect" not in text
    assert "ReadSchema: struct<x:bigint>" in text
    assert text.count("Exchange hashpartitioning") == 2  # distinct codes, then sliced codes
    once = plan(pairs(table, 12, name, unique=True, **params))
    assert once.count("Exchange hashpartitioning") == 1
    combined = plan(pairs(table, 12, name, clustered=True, **params))
    assert combined.count("Exchange hashpartitioning") == 1
    assert combined.index("partial_bit_or") > combined.index("Exchange hashpartitioning")
    assert as_pairs(df) == brute([i * 7 % 4096 for i in range(2000)])


def test_generated_code_covers_the_plan(table):
    df = pairs(table, 12, "hashing", J=4)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    for node in ("Generate", "HashAggregate", "Project"):
        lines = [line for line in final.splitlines() if f" {node} " in line or f" {node}(" in line]
        assert lines and all("*(" in line for line in lines), node


def test_costs_scan_once(table):
    df = cost_profile(table, strategy("group", 12, u=2))
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
    assert "CartesianProduct" not in final and "NestedLoop" not in final


@pytest.mark.parametrize("name,params", KINDS)
@pytest.mark.parametrize("b", [12, 63, 120])
def test_each_code_is_sent_once_per_six_bits(spark, name, params, b):
    """However many cells a strategy sends a code to."""
    if name == "group":
        params = {"u": 1} if b % 2 == 0 else None
    if params is None:
        return
    x = "id" if b <= 63 else f"lpad(conv(id, 10, 2), {b}, '0')"
    df = spark.range(1000).selectExpr(f"{x} AS x")
    sliced = plan(pairs(df, b, name, unique=True, mode="raw", **params))
    numbers = re.findall(r"Generate explode\(\[([\d,]+)\]\)", sliced)
    before_shuffle = numbers[-1].split(",")  # the lowest explode of the plan
    assert len(before_shuffle) == -(-b // 6)
    assert sliced.count("Exchange hashpartitioning") == 1


def test_record_plans(table):
    counts = record_pair_counts(table, 12)
    assert "Join" not in plan(counts) and plan(counts).count("Exchange hashpartitioning") == 2
    costs = plan(cost_profile(table, strategy("hashing", 12, J=3)))
    assert "Join" not in costs
    counts.collect()
    final = plan(counts).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
    for df in (counts, record_pairs(table, 12), record_pairs(table, 12, hot_rows=3)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "payload" not in text
