"""Every registered query against its SQL text, or for rows where it has none."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, connect

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_text_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert compare(con, df, SQL[name]) == []
    else:
        assert df.count() > 0
