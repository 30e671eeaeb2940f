"""Every registered query runs at the smallest scale and equals its SQL."""

import pytest

import __spark_entry__ as contract
from candlewick.plans.registry import QUERIES
from check import compare
from conftest import SMALL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, message, _ = compare(spark, duck, QUERIES[name], SMALL)
    assert ok, message


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["ts_code", "n_signals", "mean_ret", "win_rate", "last_signal"]
    assert df.count() > 0


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
