"""Every registered query against its SQL, at the smallest scale."""

import oracle
import pytest

from ledgerloom.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, small, connection, name):
    assert name in ORACLES
    assert oracle.compare(spark, connection, small, name, QUERIES[name], ORACLES[name]) == []


def test_entry(spark):
    import __spark_entry__ as entry_points

    assert entry_points.entry(spark).count() == 1
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
