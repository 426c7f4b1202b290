import os

import pytest
from conftest import codes_frame
from pyspark.sql import functions as F

from flipjoin import (TIMING_SCHEMA, append_report, bit_universe, cost_profile, format_keys, format_pairs,
                      keyed, pairs, payload_length, read_bitstrings, read_report, shared_folder,
                      shuffle_partitions, strategy, timing_profile, timing_summary,
                      write_bitstrings)
from flipjoin.functions import bits as fb
from flipjoin.functions.layout import Layout, section_masks, section_ranges
from flipjoin.sources.encoders import (bit_width, fold_signs, position_bitmap, sign_text,
                                       text_digests)


def test_universe(spark):
    rows = bit_universe(spark, 3, payload=10).orderBy("id").collect()
    assert [r.bits for r in rows] == [format(i, "03b") for i in range(8)]
    assert rows[5].bitstring == "1010000000" and rows[5].x == 5
    assert bit_universe(spark, 8, n=100).count() == 100
    assert payload_length(1) == 951
    for b, options in ((0, {}), (63, {}), (3, {"n": 9}), (3, {"n": -1}), (3, {"payload": 2})):
        with pytest.raises(ValueError):
            bit_universe(spark, b, **options)


def test_text_file_without_header(spark, tmp_path):
    """The first line is data: its key is empty and it must not be taken for a header."""
    file = tmp_path / "b4.csv"
    file.write_text("".join(f"{i or ''},{i:04b}{'0' * 20}\n" for i in range(16)))
    df = read_bitstrings(spark, str(file), 4, payload=True)
    rows = df.orderBy("id").collect()
    assert [(r.id, r.x, r.bits) for r in rows] == [(i, i, f"{i:04b}") for i in range(16)]
    assert rows[0].bitstring == "0" * 24
    assert pairs(df, 4).count() == 32


def test_text_roundtrip(spark, universe, tmp_path):
    path = str(tmp_path / "out")
    write_bitstrings(universe, path)
    first = [line for f in os.listdir(path) if f.endswith(".csv")
             for line in open(os.path.join(path, f)) if line.startswith((",", '"",'))]
    assert len(first) == 1
    back = read_bitstrings(spark, path, 8)
    assert back.exceptAll(universe.select("id", "bits", "x")).count() == 0
    assert back.count() == 256
    with pytest.raises(Exception):
        write_bitstrings(universe, path)
    assert read_bitstrings(spark, path, 8).columns == ["id", "bits", "x"]


def test_wide_text_file(spark, tmp_path):
    file = tmp_path / "wide.csv"
    file.write_text("".join(f"{i or ''},{i:080b}\n" for i in range(8)))
    df = read_bitstrings(spark, str(file), 80)
    assert df.columns == ["id", "bits"]
    assert pairs(df, 80, code="bits").count() == 12


def test_bad_line_fails(spark, tmp_path):
    file = tmp_path / "bad.csv"
    file.write_text("1,0101\n2,0x01\n")
    with pytest.raises(Exception):
        read_bitstrings(spark, str(file), 4).collect()


@pytest.mark.parametrize("b,section", [(8, 3), (12, 12), (12, 5), (63, 10), (10, 1)])
def test_sections_cover_all_bits(b, section):
    ranges = section_ranges(b, section)
    assert ranges[0][1] == b and ranges[-1][0] == 0
    assert all(a[0] == z[1] for a, z in zip(ranges, ranges[1:]))
    widths = [high - low for low, high in ranges]
    assert max(widths) - min(widths) <= 1
    assert sum(section_masks(b, section)) == (1 << b) - 1


@pytest.mark.parametrize("b", [1, 6, 7, 63, 64, 120, 121, 200])
def test_slices_cover_all_bits_once(b):
    layout = Layout(b)
    for ranges in ([(0, b)], [(p, p + 1) for p in range(b)], section_ranges(b, min(b, 3))):
        slices = layout.slices(ranges)
        seen = [s.position + i for s in slices for i in range(s.width)]
        assert sorted(seen) == list(range(b))
        assert all(s.width <= 6 for s in slices)


def test_bit_functions(spark):
    row = spark.createDataFrame([(0b10110100, 0b10010100, "10110100", "10010100")],
                                "x LONG, y LONG, a STRING, c STRING").select(
        fb.bits_to_long("a", 8).alias("parsed"),
        fb.long_to_bits("x", 8).alias("text"),
        fb.hamming("x", "y").alias("distance"),
        fb.text_hamming("a", "c", 8).alias("text_distance"),
        fb.is_neighbour("x", "y").alias("near"),
        fb.section_value("x", 8, 3, 0).alias("first_section"),
        fb.section_text("a", 8, 3, 0).alias("first_text"),
        fb.drop_section("x", 8, 2, 1).alias("dropped"),
        fb.drop_section_text("a", 8, 2, 1).alias("dropped_text"),
        fb.text_ones("a").alias("ones"),
        fb.pad_bits("a", 12).alias("padded"),
        fb.byte_length("a").alias("bytes"),
        fb.flip_bit("x", 0).alias("flipped"),
        fb.clear_bit("x", 2).alias("cleared"),
        fb.unordered("x", "y").alias("pair"),
        *[w.alias(n) for w, n in zip(fb.half_weights("x", 8), ("left", "right"))],
        fb.is_section_neighbour("x", "y", 8, 2, 0).alias("near_left"),
        fb.is_section_neighbour("x", "y", 8, 2, 1).alias("near_right"),
    ).first()
    assert row.parsed == 0b10110100 and row.text == "10110100"
    assert (row.distance, row.text_distance, row.near) == (1, 1, True)
    assert (row.first_section, row.first_text) == (0b10, "10")
    assert (row.dropped, row.dropped_text) == (0b10110000, "1011")
    assert (row.ones, row.padded, row.bytes) == (4, "101101000000", 8)
    assert (row.flipped, row.cleared) == (0b10110101, 0b10110000)
    assert (row.pair.lo, row.pair.hi) == (0b10010100, 0b10110100)
    assert (row.left, row.right) == (3, 1)
    assert (row.near_left, row.near_right) == (True, False)


def test_encoders(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0, 0.5, 0.25], "a"), (2, [-1.0, 2.0, None, -1.0], None)],
                               "id LONG, v ARRAY<FLOAT>, s STRING")
    rows = df.select(fold_signs("v", 4, 2).alias("x"), sign_text("v", 4).alias("t")).collect()
    assert [(r.x, r.t) for r in rows] == [(0b01, "1011"), (0b10, "0100")]
    digests = text_digests(df, "s", 16).collect()
    assert [(r.id, r.x) for r in digests] == [(1, 0x0cc1)]
    assert bit_width(spark.range(1000), "id") == 10 and bit_width(spark.range(1), "id") == 1
    seen = spark.createDataFrame([(1, 0), (1, 69), (1, 69), (2, None)], "k LONG, p INT")
    wide = {r.k: r.x for r in position_bitmap(seen, "k", F.col("p"), 70).collect()}
    assert wide == {1: "1" + "0" * 68 + "1", 2: "0" * 70}
    with pytest.raises(Exception, match="position outside"):
        position_bitmap(seen, "k", F.col("p"), 12).collect()


def test_formats(spark):
    df = pairs(codes_frame(spark, [0b0001, 0b0011]), 4)

    def text(style, **options):
        return format_pairs(df, 4, style, **options).first().result

    assert text("plain") == "[0001,0011]"
    assert text("reversed", payload=6) == "[001100,000100]"
    assert text("sections", section=2) == "[ 00 01, 00 11]"
    for style, options in (("other", {}), ("sections", {}), ("plain", {"payload": 3}),
                           ("plain", {"section": 2})):
        with pytest.raises(ValueError):
            text(style, **options)


def test_key_format(spark):
    df = keyed(codes_frame(spark, [0b0110]), strategy("hashing", 4, J=2, block_by="mod"))
    assert sorted(r.key for r in format_keys(df).collect()) == ["0,0", "0,1"]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_reports_append(spark, universe, tmp_path, fmt):
    path = str(tmp_path / "report")
    first = cost_profile(universe, strategy("serial", 8))
    append_report(first, path, fmt)
    append_report(cost_profile(universe, strategy("maxparallel", 8)), path, fmt)
    rows = read_report(spark, path, first.schema, fmt).collect()
    assert {(r.strategy, r.reducers) for r in rows} == {("serial", 1), ("maxparallel", 1024)}
    with pytest.raises(ValueError):
        append_report(first, path, "csv")


def test_timing(spark, universe):
    kinds = [strategy("serial", 8), strategy("multisection", 8, section=2)]
    profile = timing_profile(universe, kinds, reps=2)
    rows = profile.collect()
    assert len(rows) == 2 * 2 * 4
    assert {r.phase for r in rows} == {"map", "group", "reduce", "overall"}
    assert profile.schema.simpleString() == spark.createDataFrame([], TIMING_SCHEMA).schema.simpleString()
    found = {(r.strategy, r.rep, r.phase): r for r in rows}
    for name, _, _ in {(r.strategy, r.rep, 0) for r in rows}:
        for rep in range(2):  # one run: its phases add up, and each hands its rows on
            phases = [found[name, rep, p] for p in ("map", "group", "reduce")]
            overall = found[name, rep, "overall"]
            assert overall.ms == sum(p.ms for p in phases) and all(p.ms >= 0 and p.tasks > 0 for p in phases)
            assert overall.rows == phases[2].rows == 1024 and overall.shuffle_rows == sum(p.shuffle_rows for p in phases) > 0
            assert phases[0].rows == 256 * (2 if name == "multisection" else 1)
    for r in timing_summary(profile).collect():
        assert r.reps == 2 and r.ms_min <= r.ms_avg <= r.ms_max


def test_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "hdfs://warehouse/"}.get(name, default)

    assert shared_folder(Session()) == "hdfs://warehouse"


@pytest.mark.parametrize("folder", ["/data/warehouse", "file:/data/warehouse/"])
@pytest.mark.parametrize("master,fits", [("local[4]", True), ("spark://host:7077", False), ("yarn", False)])
def test_no_local_warehouse_on_a_cluster(folder, master, fits):
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": folder}.get(name, default)

        class sparkContext:
            pass

    Session.sparkContext.master = master
    if fits:
        assert shared_folder(Session()) == folder.rstrip("/")
    else:
        with pytest.raises(ValueError):
            shared_folder(Session())


def test_shuffle_partitions():
    assert shuffle_partitions(0, 4) == 1
    assert shuffle_partitions(10 ** 9, 7) > shuffle_partitions(10 ** 9, 2) > 100
