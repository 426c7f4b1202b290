import random

import pytest
from conftest import as_pairs, brute, codes_frame
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from flipjoin import Strategy, bit_universe, pairs, strategy


def all_strategies(b):
    found = [strategy("serial", b), strategy("maxparallel", b), strategy("auto", b)]
    found += [strategy("hashing", b, J=J, block_by=how)
              for J, how in ((1, "hash"), (3, "mod"), (4, "placement"))]
    found += [strategy("multisection", b, section=n) for n in sorted({2, 3, b // 2 or 1, b}) if n <= b]
    if b % 2 == 0:
        found += [strategy("group", b, u=u) for u in range(1, b // 2 + 1) if (b // 2) % u == 0]
    return found


@pytest.mark.parametrize("b", [2, 6, 13])
def test_strategies_agree_on_the_universe(spark, b):
    df = bit_universe(spark, b)
    for s in all_strategies(b):
        got = as_pairs(pairs(df, b, s))
        assert len(got) == b * 2 ** (b - 1), s


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(2, 8).map(lambda h: 2 * h), st.randoms(use_true_random=False))
def test_strategies_agree_on_random_subsets(spark, b, rnd):
    values = [rnd.randrange(2 ** b) for _ in range(rnd.randrange(1, 300))]
    values += [v ^ 1 << rnd.randrange(b) for v in values[::3]] + values[::5]
    df, want = codes_frame(spark, values).cache(), brute(values)
    for s in rnd.sample(all_strategies(b), 5):
        assert as_pairs(pairs(df, b, s)) == want, s


@pytest.mark.parametrize("b", [49, 63, 98, 128])
def test_long_codes(spark, b):
    rnd = random.Random(b)
    values = [rnd.randrange(2 ** b) for _ in range(60)]
    values += [v ^ 1 << p for v in values[:20] for p in (0, b - 1, rnd.randrange(b))]
    want = brute(values)
    assert len(want) >= 50
    text = [format(v, f"0{b}b") for v in values]
    kinds = [strategy("auto", b), strategy("serial", b), strategy("maxparallel", b),
             strategy("hashing", b, J=3), strategy("multisection", b, section=12)]
    if b % 2 == 0:
        kinds.append(strategy("group", b, u=1))
    df = codes_frame(spark, text, text=True).cache()
    for s in kinds:
        got = as_pairs(pairs(df, b, s))
        if b > 63:
            got = {(int(x, 2), int(y, 2)) for x, y in got}
        assert got == want, s
    if b <= 63:
        assert as_pairs(pairs(codes_frame(spark, values), b)) == want


@pytest.mark.parametrize("name,params", [
    ("serial", {}), ("hashing", {"J": 3}), ("group", {"u": 2}), ("maxparallel", {}),
    ("multisection", {"section": 3}), ("auto", {}),
])
def test_edge_inputs(spark, name, params):
    def run(values):
        return as_pairs(pairs(codes_frame(spark, values), 8, name, **params))

    assert run([]) == set()
    assert run([5]) == set()
    assert run([0b00000000, 0b00000011]) == set()
    assert run([7, 7]) == set()
    assert run([7, 7, 7, 6]) == {(6, 7)}
    assert run([None, 6, 7]) == {(6, 7)}
    assert run([0, 128, 255, 127]) == {(0, 128), (127, 255)}


def test_hot_code_costs_one_row_per_slice(spark):
    """A third of all rows on one code does not change the result."""
    values = list(range(64)) + [9] * 32
    assert as_pairs(pairs(codes_frame(spark, values), 8, "hashing", J=2)) == brute(values)


def test_raw_emissions_by_cell(spark):
    df = codes_frame(spark, [0b0000, 0b0001])
    rows = pairs(df, 4, "group", u=1, mode="raw", with_key=True).collect()
    assert {(r.key.gi, r.key.gj) for r in rows} == {(1, 1)}
    rows = pairs(codes_frame(spark, [1, 3]), 4, "hashing", J=2, block_by="mod", mode="raw",
                 with_key=True).collect()
    assert sorted((r.key.lo, r.key.hi) for r in rows) == [(0, 1), (1, 1)]
    rows = pairs(codes_frame(spark, [1, 3]), 4, "hashing", J=2, block_by="mod", with_key=True).collect()
    assert [(r.key.lo, r.key.hi) for r in rows] == [(1, 1)]


def test_keys_of_the_reporting_cell(spark):
    df = codes_frame(spark, [0b1010, 0b1110])
    row = pairs(df, 4, "multisection", section=2, with_key=True).first()
    assert (row.key.m, row.key.rest) == (0, 0b0010)
    row = pairs(df, 4, "maxparallel", with_key=True).first()
    assert (row.key.p, row.key.masked) == (2, 0b1010)
    assert pairs(df, 4, "serial", with_key=True).first().key.one == 1


def test_padding_is_not_compared(spark):
    df = codes_frame(spark, ["0001" + "0" * 20, "0011" + "1" * 20], text=True)
    assert as_pairs(pairs(df, 4)) == {(1, 3)}


def test_unique_and_partitions(spark, universe):
    assert pairs(universe, 8, unique=True, partitions=3).count() == 1024


def test_hints_do_not_change_the_pairs(spark):
    """Wrong hints, on repeated and scattered codes, cost time only."""
    values = [5, 200, 4, 5, 5, 201, 77, 4] * 3
    df = codes_frame(spark, values)
    for hint in ({"unique": True}, {"clustered": True}):
        for s in all_strategies(8)[:6]:
            assert as_pairs(pairs(df, 8, s, **hint)) == brute(values)


@pytest.mark.parametrize("name,params", [
    ("group", {"u": 3}), ("group", {}), ("hashing", {}), ("hashing", {"J": 0}),
    ("hashing", {"J": 2, "block_by": "row"}), ("multisection", {}), ("multisection", {"section": 11}),
    ("multisection", {"section": 0}), ("serial", {"J": 2}), ("auto", {"section": 2}), ("other", {}),
])
def test_bad_parameters(name, params):
    with pytest.raises(ValueError):
        strategy(name, 10, **params)


def test_more_bad_parameters(spark):
    with pytest.raises(ValueError):
        strategy("group", 7, u=1)
    with pytest.raises(ValueError):
        strategy("hashing", 100, J=2, block_by="mod")
    df = codes_frame(spark, [1])
    with pytest.raises(ValueError):
        pairs(df, 8, mode="all")
    with pytest.raises(ValueError):
        pairs(df, 8, Strategy("serial", 9))
    with pytest.raises(ValueError):
        pairs(df, 64)


@pytest.mark.parametrize("bad", [-1, 256])
def test_code_out_of_range_fails(spark, bad):
    with pytest.raises(Exception, match="not a 8-bit code"):
        pairs(codes_frame(spark, [bad, 1]), 8).collect()


@pytest.mark.parametrize("bad", ["0102", "01"])
def test_text_that_is_no_bitstring_fails(spark, bad):
    with pytest.raises(Exception, match="not a bitstring"):
        pairs(codes_frame(spark, [bad], text=True), 4).collect()
