"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, duck_table, duck_types, spark_table, spark_types
from tidemark.plans import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracle_sql())


def test_all_are_registered():
    assert set(queries.queries()) <= set(entry.queries())
    assert set(oracles.oracle_sql()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, database, name):
    df, sql = queries.queries()[name](spark, SF_DIR), oracles.oracle_sql()[name]
    assert spark_types(df) == duck_types(database, sql)
    assert spark_table(df) == duck_table(database, sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
