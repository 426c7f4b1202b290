"""Strategies on their own cells: the same pairs and emissions as by slices, with the plans they are named for."""

import random
from collections import Counter

import pytest
from conftest import as_pairs, brute, codes_frame
from pyspark.sql import functions as F
from test_pairs import all_strategies
from test_plans import FORBIDDEN, plan

from flipjoin import pairs, strategy
from flipjoin.operators import cell_joins
from flipjoin.operators.codes import with_words, word_names
from flipjoin.operators.groups import group_sizes


def emissions(df):
    return Counter((str(r.key), r.x_lo, r.x_hi) for r in df.collect())


def some_codes(b, n, seed=0):
    rnd = random.Random(seed)
    values = [rnd.randrange(2 ** b) for _ in range(n)]
    values += [v ^ 1 << rnd.randrange(b) for v in values] + [v ^ 1 << rnd.randrange(b) for v in values[::2]]
    return values + values[::5]


@pytest.mark.parametrize("b", [2, 8, 13])
def test_same_emissions_as_slices(spark, b):
    values = some_codes(b, 60, b)
    df, want = codes_frame(spark, values + [None]).cache(), brute(values)
    for s in all_strategies(b):
        for mode in ("distinct", "raw"):
            got = emissions(pairs(df, b, s, mode=mode, with_key=True, execution="cells"))
            assert got == emissions(pairs(df, b, s, mode=mode, with_key=True)), (s, mode)
            if mode == "distinct":
                assert sorted((x, z) for _, x, z in got.elements()) == sorted(want), s


@pytest.mark.parametrize("b", [62, 63, 64, 128])
def test_long_codes(spark, b):
    values = some_codes(b, 40, b)
    want = brute(values)
    df = codes_frame(spark, [format(v, f"0{b}b") for v in values], text=True).cache()
    kinds = [strategy("serial", b), strategy("hashing", b, J=3), strategy("maxparallel", b), strategy("multisection", b, section=2),
             strategy("multisection", b, section=5)] + ([strategy("group", b, u=1)] if b % 2 == 0 else [])
    for s in kinds:
        got = as_pairs(pairs(df, b, s, execution="cells"))
        assert {(int(x, 2), int(z, 2)) if b > 63 else (x, z) for x, z in got} == want, s


@pytest.mark.parametrize("name,params", [("serial", {}), ("hashing", {"J": 1}), ("hashing", {"J": 3}), ("hashing", {"J": 2, "block_by": "mod"})])
@pytest.mark.parametrize("cell_rows", [10, 45])
def test_large_blocks_are_cut(spark, name, params, cell_rows):
    """Of even numbers one block of two has all codes; cut, no cell has many more than asked for."""
    values = [2 * v for v in some_codes(9, 100)]
    df, s = codes_frame(spark, values), strategy(name, 10, **params)
    for mode in ("distinct", "raw"):
        cut = pairs(df, 10, s, mode=mode, with_key=True, execution="cells", cell_rows=cell_rows)
        assert emissions(cut) == emissions(pairs(df, 10, s, mode=mode, with_key=True))
    codes = with_words(df, "x", s.layout).select(*word_names(s.layout)).distinct()
    cuts = cell_joins.cut_blocks(codes, s, cell_rows)
    assert max(cuts) > 1
    sizes = cell_joins.map_blocks(codes, s, cuts).groupBy("ulo", "uhi").count()
    assert max(r["count"] for r in sizes.collect()) < 2.5 * cell_rows + 12


@pytest.mark.parametrize("J", [2, 3, 4])
def test_cells_of_the_shuffle_are_the_groups(spark, J):
    df, s = codes_frame(spark, sorted(set(some_codes(8, 90)))), strategy("hashing", 8, J=J)
    codes = with_words(df, "x", s.layout).select(*word_names(s.layout))
    rows = cell_joins.map_blocks(codes, s, cell_joins.cut_blocks(codes, s)).groupBy("lo", "hi").count().collect()
    assert {(r.lo, r.hi): r["count"] for r in rows} == {(r.key.lo, r.key.hi): r.q for r in group_sizes(df, s).collect()}


@pytest.mark.parametrize("name,params,shuffles", [
    ("serial", {}, 1), ("hashing", {"J": 4}, 1), ("group", {"u": 2}, 1), ("maxparallel", {}, 1), ("multisection", {"section": 3}, 2)])
def test_plans(spark, tmp_path, name, params, shuffles):
    """One shuffle by cell (two sides of the join), nothing gathered, no product, no Python."""
    path = str(tmp_path / "codes")
    spark.range(3000).selectExpr("id * 7 % 4096 AS x", "repeat('z', 50) AS payload").write.parquet(path)
    df = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(pairs(df, 12, name, unique=True, execution="cells", mode="raw", with_key=True, **params))
        assert not [word for word in FORBIDDEN if word in text] and "collect" not in text
        assert text.count("Exchange hashpartitioning") == shuffles and "ReadSchema: struct<x:bigint>" in text
        assert ("Join" in text) == (name == "multisection")
        assert as_pairs(pairs(df, 12, name, execution="cells", **params)) == brute([i * 7 % 4096 for i in range(3000)])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bad_parameters(spark):
    df = codes_frame(spark, [1, 3])
    with pytest.raises(ValueError):
        pairs(df, 8, execution="rows")
    with pytest.raises(ValueError):
        pairs(df, 20, "hashing", J=5000, execution="cells")
    assert pairs(codes_frame(spark, []), 8, "hashing", J=3, execution="cells").count() == 0


@pytest.mark.parametrize("name,params", [("serial", {}), ("hashing", {"J": 2}), ("group", {"u": 3})])
def test_no_shuffle_key_gathers_a_cell(spark, name, params):
    """Half of all codes lie in one cell, equal in one half; a shuffle key gets 2^12 codes at most, not the cell."""
    values = [v << 18 for v in range(0, 1 << 18, 13)] + [v for v in range(1 << 18) if v % 13 == 1]
    df, s = codes_frame(spark, values), strategy(name, 36, **params)
    codes = with_words(df, "x", s.layout).select(*word_names(s.layout))
    mapped, grouped, _ = cell_joins.cell_steps(codes, s, False, partitions=64)
    cells = mapped().groupBy(*(["gi", "gj"] if name == "group" else ["ulo", "uhi"])).count()
    dealt = grouped(mapped()).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in cells.collect()) > len(values) // 20
    sizes = [r["count"] for r in dealt.collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / 64
