"""Every registered query against its SQL on the small tables."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from foliolens.plans.expected_sql import expected_sql
from foliolens.plans.queries import QUERIES

SQL = expected_sql()


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, connection, name):
    assert differences(QUERIES[name](spark, sf_dir), connection, SQL[name]) == []


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
