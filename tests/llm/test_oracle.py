import pytest

from latticework.llm import queries

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name], sf_dir)


def test_ten_operators_are_registered():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)} and "pipeline" in e.queries()
