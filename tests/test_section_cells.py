"""Cells of strategies that mask a range: dealt by routes, without texts, and equal to a plain grouping."""

import random
from collections import Counter, defaultdict

import pytest
from conftest import codes_frame
from test_plans import plan

from flipjoin import cost_profile, group_sizes, groups, keyed, strategy

KINDS = [("maxparallel", {}), ("multisection", {"section": 42}), ("multisection", {"section": 4}), ("multisection", {"section": 9})]


def plain(values, s):
    cells = defaultdict(list)
    for v in values:
        for m, (low, high) in enumerate(s.free_ranges):
            cells[m, v & ~((1 << high) - (1 << low))].append(v)
    return cells


@pytest.mark.parametrize("b", [42, 63, 65, 84])
@pytest.mark.parametrize("name,params", KINDS)
def test_cells(spark, b, name, params):
    rnd = random.Random(b)
    values = [rnd.getrandbits(b) & rnd.getrandbits(b) for _ in range(12)] + [0, 0, 1, 1 << b - 1, (1 << b) - 1]
    values += [v ^ 1 << rnd.randrange(b) for v in values]
    s = strategy(name, b, **params)
    df, wide = codes_frame(spark, [format(v, f"0{b}b") + "-more" for v in values], text=True), b > 63
    want = plain(values, s)

    def number(x):
        return int(x, 2) if wide else x

    sizes = group_sizes(df, s, partitions=3).collect()
    assert {(r.key[0], number(r.key[1])): r.q for r in sizes} == {k: len(c) for k, c in want.items()} and len(sizes) == len(want)
    got = Counter((r.key[0], number(r.key[1]), r.x) for r in keyed(df, s).collect())
    assert got == Counter((m, rest, format(v, f"0{b}b") + "-more") for (m, rest), c in want.items() for v in c)
    cost = cost_profile(df, s, partitions=3).first()
    assert (cost.q_max, cost.q_sum, cost.reducers) == (max(map(len, want.values())), len(values) * len(s.free_ranges), len(want))
    if s.cell_bound <= 4096:
        listed = groups(df, s, partitions=3).collect()
        assert {(r.key[0], number(r.key[1])): [number(x) for x in r.members] for r in listed} == {k: sorted(set(c)) for k, c in want.items()}


def test_no_text_is_shuffled(spark):
    """Cells are keyed by words where their route is; before, every cell's key and member went as texts."""
    df = codes_frame(spark, ["01" * 42, "10" * 42], text=True)
    for s in (strategy("maxparallel", 84), strategy("multisection", 84, section=42)):
        for made in (group_sizes(df, s), groups(df, s)):
            text = plan(made)
            assert "hashpartitioning(_o0" in text and "hashpartitioning(key" not in text and "collect" not in text


def test_a_code_is_formatted_once(spark):
    text = plan(keyed(codes_frame(spark, ["01" * 42], text=True), strategy("maxparallel", 84)))
    assert "lpad(bin" in text and text.index("Generate") < text.index("lpad(bin")
