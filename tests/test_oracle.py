import pytest

from latticework import queries

from .oracle import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name], sf_dir)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "name", "caller_count"]
    assert set(queries.QUERIES) <= set(e.queries()) and set(queries.SQL) <= set(e.oracle_sql())
