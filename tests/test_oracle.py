"""Every named query against its SQL, run by DuckDB on the same files."""

import pytest

import __spark_entry__ as entry_points
from geoaffinity.catalog.oracle import ORACLE_SQL
from geoaffinity.catalog.queries import QUERIES
from tests.oracle_check import differences, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_gives_the_stated_rows(spark, con, name):
    assert differences(QUERIES[name](spark, FOLDER), con, ORACLE_SQL[name]) is None


def test_all_are_registered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE_SQL) <= set(entry_points.oracle_sql())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 5
