"""Every registered query against its SQL check on the smallest tables."""

import pytest

import __spark_entry__ as entry
from parity import compare, connect
from tamarisk import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = catalog.oracles().get(name)
    if sql is None:
        assert len(df.collect()) > 0
    else:
        assert compare(df, con, sql) is None


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.queries()) == set(catalog.oracles())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
