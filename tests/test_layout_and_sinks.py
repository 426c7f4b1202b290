"""Bucketed code tables, appends that can be repeated, scans with rejects, key volumes."""

import re
import uuid

import pytest
from conftest import as_pairs, brute, codes_frame
from pyspark.sql import functions as F
from test_cell_joins import some_codes
from test_plans import plan

from flipjoin import (append_report, bucket_of, cost_profile, format_keys, key_volume, keyed, read_bitstrings, read_report,
                      scan_bitstrings, stored_pairs, strategy, write_codes)


def written(spark, tmp_path, values, s, buckets=4, text=False):
    name = f"codes_{uuid.uuid4().hex}"
    df = codes_frame(spark, [format(v, f"0{s.b}b") for v in values] if text else values, text=text)
    write_codes(df, s, name, str(tmp_path / name), buckets)
    return name


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_second_join_shuffles_nothing(spark, tmp_path, no_broadcast):
    s = strategy("multisection", 12, section=3)
    values, more = some_codes(12, 80), some_codes(12, 80, seed=1)
    one, two = written(spark, tmp_path, values, s), written(spark, tmp_path, more, s)
    again = stored_pairs(spark, s, one)
    assert "Exchange" not in plan(again) and "SortMergeJoin" in plan(again)
    assert as_pairs(again) == brute(values)
    both = stored_pairs(spark, s, one, two)
    assert "Exchange" not in plan(both)
    want = sorted((x, y) for x in set(values) for y in set(more) if (x ^ y).bit_count() == 1)
    assert sorted((r.x, r.y) for r in both.collect()) == want and want


@pytest.mark.parametrize("b,section", [(64, 5), (128, 2), (70, 7)])
def test_wide_codes(spark, tmp_path, b, section):
    s, values = strategy("multisection", b, section=section), some_codes(b, 30)
    found = stored_pairs(spark, s, written(spark, tmp_path, values, s, text=True))
    assert {(int(r.x_lo, 2), int(r.x_hi, 2)) for r in found.collect()} == brute(values)


def test_placement_names_real_buckets(spark, tmp_path):
    s = strategy("multisection", 12, section=4)
    name = written(spark, tmp_path, some_codes(12, 100), s, buckets=5)
    rows = spark.table(name).select(bucket_of(s, 5).alias("b"), F.input_file_name().alias("f")).distinct().collect()
    numbers = {int(re.search(r"_(\d{5})\.", r.f).group(1)): r.b for r in rows}
    assert len(rows) == len(numbers) == 5 and all(k == v for k, v in numbers.items())
    with pytest.raises(ValueError):
        write_codes(codes_frame(spark, [1]), strategy("serial", 8), "t", str(tmp_path / "t"), 2)


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_a_repeated_append_leaves_its_rows_once(spark, universe, tmp_path, fmt):
    path = str(tmp_path / "report")
    first, second = (cost_profile(universe, strategy(n, 8)) for n in ("serial", "maxparallel"))
    assert append_report(first, path, fmt, run_id="7") == "7"
    append_report(second, path, fmt, run_id="8")
    append_report(first, path, fmt, run_id="7")
    rows = read_report(spark, path, first.schema, fmt, runs=True).collect()
    assert sorted((r.run_id, r.strategy) for r in rows) == [("7", "serial"), ("8", "maxparallel")]
    assert append_report(second, path, fmt) != append_report(second, path, fmt)  # runs of their own
    assert read_report(spark, path, "strategy STRING, q_max BIGINT", fmt).count() == 4
    with pytest.raises(ValueError):
        append_report(first.withColumn("run_id", F.lit(1)), path, fmt)


def test_scan_with_rejects(spark, tmp_path):
    lines = [",0101000", "1,0111", "2,01", "x,0101", "3,0x01", "4,0101,9", "5", "", "6,10110", "7,", "-8,0101", "99999999999999999999,0101", "9,0000"]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    codes, rejects = scan_bitstrings(spark, str(tmp_path / "f.csv"), 4, payload=True)
    assert [(r.id, r.bits, r.x, r.bitstring) for r in codes.orderBy("id").collect()] == [
        (0, "0101", 5, "0101000"), (1, "0111", 7, "0111"), (6, "1011", 11, "10110"), (9, "0000", 0, "0000")]
    found = {r.line: r.reason for r in rejects.collect()}
    assert found == {"2,01": "bits", "x,0101": "key", "3,0x01": "bits", "4,0101,9": "fields", "5": "fields", "": "fields", "7,": "bits",
                     "-8,0101": "key", "99999999999999999999,0101": "key"}
    assert codes.count() + len(found) == len(lines)
    good = tmp_path / "good.csv"
    good.write_text(",0101\n1,0111\n2,1100\n")
    codes, rejects = scan_bitstrings(spark, str(good), 4)
    assert rejects.count() == 0 and sorted(codes.collect()) == sorted(read_bitstrings(spark, str(good), 4).collect())
    assert "x" not in scan_bitstrings(spark, str(good), 70)[0].columns


@pytest.mark.parametrize("name,params", [("serial", {}), ("hashing", {"J": 3}), ("group", {"u": 2}), ("maxparallel", {}), ("multisection", {"section": 3})])
def test_key_volume(spark, name, params):
    df, s = codes_frame(spark, some_codes(12, 50) + [None]), strategy(name, 12, **params)
    sizes = [len(r.key) for r in format_keys(keyed(df, s)).collect()]
    assert tuple(key_volume(df, s).first()) == (len(sizes), sum(sizes), max(sizes))
    assert tuple(key_volume(df.limit(0), s).first()) == (0, 0, 0)
