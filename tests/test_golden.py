"""The recorded cost profiles of the full 8-bit universe."""

import pytest

from flipjoin import cost_profile, cost_profiles, pairs, size_histogram, strategy

# Map in, map out, reducer in KB, reducer out KB, largest cell,
# sum of cells, cells and histogram {size: cells} at b=8, k=1.
GOLDEN = {
    ("serial", None): (256, 256, 256, 2048, 256, 256, 1, {256: 1}),
    ("group", 2): (256, 448, 448, 2528, 121, 448, 4, {85: 1, 121: 3}),
    ("maxparallel", None): (256, 2048, 2048, 2048, 2, 2048, 1024, {2: 1024}),
    ("multisection", 4): (256, 1024, 1024, 2048, 4, 1024, 256, {4: 256}),
    ("multisection", 2): (256, 512, 512, 2048, 16, 512, 32, {16: 32}),
}


def make(name, value):
    param = {"group": "u", "multisection": "section", "hashing": "J"}.get(name)
    extra = {"block_by": "mod"} if name == "hashing" else {}
    return strategy(name, 8, **({param: value} if param else {}), **extra)


@pytest.mark.parametrize("unique", [True, False])
@pytest.mark.parametrize("key", GOLDEN, ids=str)
def test_recorded_profile(universe, key, unique):
    want = GOLDEN[key]
    s = make(*key)
    row = cost_profile(universe, s, unique=unique).first()
    got = (row.map_in, row.map_out, row.red_in_kb, row.red_out_kb, row.q_max, row.q_sum, row.reducers)
    assert got == want[:7]
    assert (row.map_in_kb, row.map_out_kb) == (want[0], want[1])
    assert {r.q: r.n for r in size_histogram(universe, s).collect()} == want[7]


# Group width and value blocks with the emissions they lead to.
EMISSIONS = [
    ("group", 1, 1136, 704, 16, 84),
    ("group", 4, 1024, 256, 1, 256),
    ("multisection", 8, 1024, 2048, 1024, 2),
    ("hashing", 2, 1920, 512, 3, 256),
    ("hashing", 3, 1024, 768, 6, 171),
    ("hashing", 4, 3328, 1024, 10, 128),
]


@pytest.mark.parametrize("name,value,emitted,keyed_rows,cells,largest", EMISSIONS)
def test_emissions(universe, name, value, emitted, keyed_rows, cells, largest):
    s = make(name, value)
    row = cost_profile(universe, s).first()
    assert (row.red_out_kb, row.map_out, row.reducers, row.q_max) == (
        2 * emitted, keyed_rows, cells, largest)
    assert pairs(universe, 8, s, mode="raw").count() == emitted
    assert pairs(universe, 8, s).count() == 8 * 2 ** 7


@pytest.mark.parametrize("J", [2, 3, 4])
@pytest.mark.parametrize("block_by", ["hash", "placement"])
def test_hashed_blocks(universe, J, block_by):
    """Emissions are J for a pair inside a block and one for a pair across blocks."""
    s = strategy("hashing", 8, J=J, block_by=block_by)
    row = cost_profile(universe, s).first()
    raw = pairs(universe, 8, s, mode="raw", with_key=True)
    inside = pairs(universe, 8, s, with_key=True).where("key.lo = key.hi").count()
    assert row.map_out == J * 256 and row.reducers == J * (J + 1) // 2
    assert raw.count() == J * inside + (1024 - inside) == row.red_out_kb // 2


def test_key_volume_and_size(universe):
    s = make("multisection", 4)
    row = cost_profile(universe, s, k=3, key_volume=2).first()
    assert (row.map_in_kb, row.map_out_kb, row.red_in_kb, row.red_out_kb) == (
        768, 1024 * 5, 1024 * 5, 1024 * 8)


def test_profiles_of_several_strategies(universe):
    rows = cost_profiles(universe, [make("serial", None), make("group", 2)]).collect()
    assert [(r.strategy, r.param) for r in rows] == [("serial", 0), ("group", 2)]


def test_profile_weighs_copies(spark):
    """Three copies of one code and two of its neighbour: six record pairs."""
    df = spark.createDataFrame([(0,)] * 3 + [(1,)] * 2, "x BIGINT")
    row = cost_profile(df, strategy("maxparallel", 8)).first()
    assert (row.map_in, row.map_out, row.red_out_kb, row.q_max) == (5, 40, 12, 5)
    row = cost_profile(df, strategy("hashing", 8, J=2, block_by="mod")).first()
    assert row.red_out_kb == 12
    row = cost_profile(df, strategy("hashing", 8, J=1)).first()
    assert row.red_out_kb == 12


def test_profile_of_nothing(spark):
    row = cost_profile(spark.createDataFrame([], "x BIGINT"), strategy("maxparallel", 8)).first()
    assert (row.map_in, row.map_out, row.red_out_kb, row.q_max, row.reducers) == (0, 0, 0, 0, 0)
