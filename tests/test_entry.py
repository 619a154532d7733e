"""The driver contract, and a few registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


def test_entry(spark):
    assert entry.entry(spark).filter("year = 'ALL'").count() == 1


@pytest.mark.parametrize("name", ["a15_ecl_backtest", "p19_on_time_rate", "a04_woe_iv", "x1_stratified_split", "m8_ipcw_concordance",
                                  "n12_break_even_target_apr", "j2_loans_state"])
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) == ""
