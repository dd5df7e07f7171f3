"""Every registered query: equal to its SQL, or, without SQL, runs and keeps its rows."""

import pytest

import __spark_entry__ as driver
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"
ORACLES = driver.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert difference(driver.queries()[name](spark, FOLDER), ORACLES[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert driver.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["l_returnflag", "l_extendedprice"]
