from collections import Counter

import pytest
from conftest import codes_frame

from flipjoin import (code_counts, emits_histogram, group_sizes, groups, keyed, partition_sizes,
                      record_pair_counts, record_pairs, size_histogram, strategy)
from flipjoin.operators.records import record_sides
from pyspark.sql import functions as F

VALUES = [0, 0, 0, 0, 0, 0, 1, 1, 1, 2, 7, 7, 40]


def brute_records(values):
    return Counter(
        (i, j, x, y)
        for i, x in enumerate(values) for j, y in enumerate(values)
        if x < y and (x ^ y).bit_count() == 1
    )


@pytest.mark.parametrize("hot_rows", [1, 2, 5, 100])
def test_record_pairs(spark, hot_rows):
    """The same records whether hot codes are split or not."""
    df = codes_frame(spark, VALUES)
    got = record_pairs(df, 6, hot_rows=hot_rows).collect()
    assert Counter(map(tuple, got)) == brute_records(VALUES)


def test_no_join_key_gathers_more_than_a_part(spark):
    """Both sides of the last join: ten neighbours of one code, 1,000 records each."""
    hub = [0] * 1000 + [1 << p for p in range(10) for _ in range(1000)]
    left, right, on = record_sides(codes_frame(spark, hub), strategy("auto", 10), "x", "id", [], "distinct", 100)
    for side in (left, right):
        sizes = [r["count"] for r in side.groupBy(*on).count().collect()]
        assert len(sizes) == 10 * 10 * 10 and max(sizes) < 200
    assert left.join(right, on).count() == 10 * 1000 * 1000


def test_one_plan_at_every_size(spark):
    small, large = (record_pairs(codes_frame(spark, VALUES * n), 6, hot_rows=5)._jdf.queryExecution().analyzed().toString()
                    for n in (1, 50))
    shape = lambda plan: [line.strip(" :+-").split(" ")[0] for line in plan.splitlines()]
    assert shape(small) == shape(large)


def test_counts_beyond_bigint(spark):
    """Two codes of 4 * 10^9 records each: their pairs do not fit a BIGINT once weighted."""
    from flipjoin.operators.pairs import word_pairs
    from flipjoin.plans.cost import _emissions

    counted = spark.createDataFrame([(0, 4 * 10**9), (1, 4 * 10**9)], "_w0 bigint, n bigint")
    assert _emissions(counted, strategy("hashing", 4, J=3), False).first().e == 16 * 10**18
    row = word_pairs(counted, strategy("auto", 4), count="n").first()
    assert (row.n_lo, row.n_hi) == (4 * 10**9, 4 * 10**9)


def test_record_pairs_with_payload(spark):
    df = codes_frame(spark, VALUES).withColumn("name", F.concat(F.lit("n"), "id"))
    rows = record_pairs(df, 6, "serial", payload=["name"], hot_rows=2).collect()
    assert rows and all((r.name_a, r.name_b) == (f"n{r.id_a}", f"n{r.id_b}") for r in rows)


def test_raw_record_pairs_repeat_per_cell(spark):
    df = codes_frame(spark, [1, 3, 3])
    rows = record_pairs(df, 4, "hashing", mode="raw", J=3, block_by="mod").collect()
    assert Counter(map(tuple, rows)) == {(0, 1, 1, 3): 1, (0, 2, 1, 3): 1}
    rows = record_pairs(df, 4, "hashing", mode="raw", J=2, block_by="mod").collect()
    assert Counter(map(tuple, rows)) == {(0, 1, 1, 3): 2, (0, 2, 1, 3): 2}


def test_text_records(spark):
    b = 70
    text = [format(v << 60, f"0{b}b") for v in VALUES]
    got = record_pairs(codes_frame(spark, text, text=True), b).collect()
    want = Counter((i, j, text[i], text[j]) for (i, j, _, _) in brute_records(VALUES).elements())
    assert Counter(map(tuple, got)) == want


def test_record_pair_counts(spark):
    df = codes_frame(spark, VALUES)
    rows = {(r.x_lo, r.x_hi): (r.n_lo, r.n_hi) for r in record_pair_counts(df, 6).collect()}
    assert rows == {(0, 1): (6, 3), (0, 2): (6, 1)}
    assert sum(a * c for a, c in rows.values()) == sum(brute_records(VALUES).values())
    assert {r.x: r.n for r in code_counts(df, 6).collect()} == Counter(VALUES)


def key_rows(df, s, *fields):
    return sorted(tuple(r.key) + (r.x,) for r in keyed(df, s).collect())


def test_keys(spark):
    df = codes_frame(spark, [0b0110])
    assert key_rows(df, strategy("serial", 4)) == [(1, 6)]
    assert key_rows(df, strategy("hashing", 4, J=4, block_by="mod")) == [
        (0, 2, 6), (1, 2, 6), (2, 2, 6), (2, 3, 6)]
    assert key_rows(df, strategy("maxparallel", 4)) == [(0, 6, 6), (1, 4, 6), (2, 2, 6), (3, 6, 6)]
    assert key_rows(df, strategy("multisection", 4, section=2)) == [(0, 2, 6), (1, 4, 6)]
    # both halves weigh 1, the border of cell 2 at width 1
    assert key_rows(df, strategy("group", 4, u=1)) == [(1, 2, 6), (2, 1, 6), (2, 2, 6)]
    assert key_rows(df, strategy("group", 4, u=2)) == [(1, 1, 6)]


def test_keys_keep_the_columns_of_the_user(spark):
    df = codes_frame(spark, [3]).withColumns({"lo": F.lit("a"), "gi": F.lit("z"), "t": F.lit(1)})
    for s in (strategy("hashing", 4, J=2), strategy("group", 4, u=1), strategy("serial", 4)):
        assert keyed(df, s).columns == ["key", "id", "x", "lo", "gi", "t"]
        assert keyed(df, s).first().lo == "a"


def test_text_keys(spark):
    b = 70
    df = codes_frame(spark, ["1" * b], text=True)
    rest = {r.key.m: r.key.rest for r in keyed(df, strategy("multisection", b, section=2)).collect()}
    assert rest == {0: "0" * 35 + "1" * 35, 1: "1" * 35 + "0" * 35}
    rows = keyed(df, strategy("maxparallel", b)).collect()
    assert {r.key.masked.count("0") for r in rows} == {1} and len(rows) == b


def test_group_sizes_and_histograms(spark):
    df = codes_frame(spark, VALUES)
    s = strategy("hashing", 6, J=2, block_by="mod")
    even = sum(v % 2 == 0 for v in VALUES)
    odd = len(VALUES) - even
    sizes = {tuple(r.key): r.q for r in group_sizes(df, s).collect()}
    assert sizes == {(0, 0): even, (0, 1): even + odd, (1, 1): odd}
    assert {r.q: r.n for r in size_histogram(df, s).collect()} == Counter(sizes.values())
    for s in (s, strategy("group", 6, u=1), strategy("maxparallel", 6), strategy("serial", 6),
              strategy("multisection", 6, section=4)):
        per_record = Counter(Counter(r.id for r in keyed(df, s).collect()).values())
        assert {r.r: r.n for r in emits_histogram(df, s).collect()} == per_record


def test_groups(spark):
    df = codes_frame(spark, [0, 1, 1, 2, 8])
    listed = groups(df, strategy("multisection", 4, section=2))
    got = {tuple(r.key): r.members for r in listed.collect()}
    assert got == {(0, 0): [0, 8], (0, 1): [1], (0, 2): [2], (1, 0): [0, 1, 2], (1, 8): [8]}
    assert max(len(r.members) for r in groups(df, strategy("maxparallel", 4)).collect()) == 2
    for s in (strategy("serial", 4), strategy("group", 4, u=1), strategy("hashing", 4, J=2),
              strategy("multisection", 60, section=2)):
        with pytest.raises(ValueError):
            groups(df, s)


def test_groups_of_padded_text(spark):
    """What follows the significant bits is no part of a code."""
    df = codes_frame(spark, [f"0001{'x' * n}" for n in range(300)] + ["0011", "0011 "], text=True)
    for r in groups(df, strategy("multisection", 4, section=2)).collect():
        assert set(r.members) <= {1, 3} and len(r.members) == len(set(r.members))
    wide = codes_frame(spark, ["1" * 70 + tail for tail in ("", "00", "zz")], text=True)
    assert {tuple(r.members) for r in groups(wide, strategy("maxparallel", 70)).collect()} == {("1" * 70,)}


def test_placement_blocks_are_partitions(spark):
    """The block by placement is the partition that a repartition by value gives."""
    from flipjoin.operators.keys import block_of

    s = strategy("hashing", 10, J=4, block_by="placement")
    df = spark.range(1000).withColumnRenamed("id", "x").repartition(4, "x")
    rows = df.select(F.spark_partition_id().alias("p"), block_of([F.col("x")], s).alias("block"))
    assert rows.where("p <> block").count() == 0
    sizes = {r.partition: r.n for r in partition_sizes(df).collect()}
    assert sum(sizes.values()) == 1000 and len(sizes) == 4
