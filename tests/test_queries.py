"""Every registered query beside its checking SQL, on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query(spark, con, name):
    ok, _, _, why = compare(spark, SF, name, driver.queries()[name], driver.oracle_sql().get(name), con)
    assert ok, why


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["event_id", "related_user", "related_source_ip", "event_count", "first_seen", "severity"]
    assert df.count() > 0
