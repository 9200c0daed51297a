"""Every registered query beside its SQL, all rows, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import flows, loops, names, series
from checks.run import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(n for group in (names, loops, series, flows) for n in group.SQL))
def test_query_equals_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, SF, QUERIES[name], SQL[name])
    assert verdict == "ok"


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_library_query_has_sql():
    for group in (names, loops, series, flows):
        assert set(group.QUERIES) == set(group.SQL)
