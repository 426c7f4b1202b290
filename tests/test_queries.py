"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as driver
from check_queries import compare, database
from flipjoin.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(driver.SMALL), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return database(driver.SMALL)


def test_entry(spark):
    assert driver.entry(spark).columns == ["x_lo", "x_hi"]
    assert driver.entry(spark).count() > 0


def test_every_query_of_the_library_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


# the whole list is run by tools/check_queries.py
SAMPLE = [name for name in ORACLES
          if name.endswith(("_months", "_turns", "_turns_split", "section_shipping", "group_shipping")) or name.startswith(("pairs_auto", "pairs_formatted"))
          or name in ("csv_roundtrip", "bit_universe", "report_append", "cost_multisection_orders")]


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    df = driver.queries()[name](spark, driver.SMALL)
    assert compare(df, con, driver.oracle_sql()[name]) is None


def test_ship_dates_of_any_year(spark, tmp_path):
    """The window of months follows the table."""
    from datetime import datetime

    spark.createDataFrame([(1, datetime(2005, 3, 1)), (2, datetime(2005, 3, 9)), (2, datetime(1990, 1, 1)), (3, datetime(1990, 2, 1))],
                          "l_orderkey long, l_shipdate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = database(str(tmp_path), "/*.parquet")
    for name in ("pairs_auto_shipping", "codes_shipping", "keys_multisection_shipping"):
        assert compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name]) is None, name
