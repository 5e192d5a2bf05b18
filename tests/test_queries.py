"""Every catalogued query against its independent SQL."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, queries()[name], oracle_sql()[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 269


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
