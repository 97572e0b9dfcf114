import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.plans.grammar import AGGREGATES, Aggregate, Both, Compare, Either, Literal, Not, Path, QueryError, parse
from latticework.plans.query import rows, run


@pytest.fixture(scope="module")
def views(spark):
    found = [(1, "alpha", 3, 1.5, True, ["old", "cached"]), (2, "beta", None, None, None, None), (3, None, 0, 0.1 + 0.2, False, []), (4, "order_in", -2, 2.0, True, ["deprecated"])]
    df = spark.createDataFrame(found, "id int, name string, n int, x double, flag boolean, decorators array<string>").selectExpr("*", "named_struct('name', concat('m', id)) as module")
    return {"functions": df}


def ids(views, where):
    return sorted(r.id for r in run(f"functions select id where {where}", views).collect())


CASES = {
    "n > 0": [1], "not n > 0": [2, 3, 4], "n != 3": [3, 4], "n == 3.0": [1], "x == 0.3": [3], "x != 0.3": [1, 4], "x == 2": [4], "n == -2": [4], "name == 'alpha'": [1], "name != 'alpha'": [2, 4], "name > 'a'": [], "name == 3": [], "name != 3": [],
    "flag == true": [1, 4], "flag != true": [3], "not flag == true": [2, 3], "name contains 'ta'": [2], "decorators contains 'ache'": [1], "decorators contains 3": [], "name matches '^[ab]'": [1, 2], "name in ['alpha', 'beta', 3]": [1, 2], "n in [0, 3]": [1, 3], "n in []": [],
    "nowhere == 1": [], "not nowhere == 1": [1, 2, 3, 4], "n == null": [2], "name != null": [1, 2, 4], "(n == 3 or n == 0) and flag == true": [1], "n == 3 or n == 0 and flag == true": [1], "not (n == 3 or n == 0)": [2, 4], "contains(decorators, 'dep')": [4], "contains(decorators, 'dep') == false": [1, 2, 3],
    "module.name == 'm2'": [2], "3 == n": [1], "n < x": [3, 4], "(((n == 3)))": [1], "name == \"alpha\" -- why": [1],
}


@pytest.mark.parametrize("where", sorted(CASES))
def test_two_valued_logic(views, where):
    assert ids(views, where) == CASES[where]


def test_order_limit_and_projection(views):
    get = lambda q: [tuple(r) for r in run(q, views).collect()]
    assert get("functions select id, nothing order by n desc") == [(1, None), (3, None), (4, None), (2, None)]
    assert get("functions select name order by n asc limit 2") == [("order_in",), (None,)]
    assert get("functions select module.name order by id desc limit 1") == [("m4",)]
    assert get("functions select id limit 2") == [(1,), (2,)]
    assert get("functions limit 0") == [] and len(run("functions", views).columns) == 7
    assert run("functions select module.name limit 1", views).columns == ["module_name"]


def test_aggregates(views):
    get = lambda q: [tuple(r) for r in run(q, views).collect()]
    assert get("functions select count(*) as c, count(n) as k, sum(n) as s, avg(x) as a, min(name) as f, max(n) as m") == [(4, 3, 1, pytest.approx((1.5 + 0.3 + 2) / 3), "alpha", 3)]
    assert get("functions select flag, count(*) as c group by flag order by c desc limit 1") == [(True, 2)]
    assert sorted(get("functions select name, count(*) as c group by flag"), key=str) == [("alpha", 2), ("beta", 1), (None, 1)]
    assert len(get("functions group by flag")) == 3


@pytest.mark.parametrize("text", [
    "", "functions where", "tables", "functions where n", "functions where n >", "functions limit -1", "functions limit 2.5", "functions limit x", "functions where (n == 1", "functions select count(*)", "functions select sum(*) as s", "functions where n == 1 garbage", "functions order n", "functions where n ~ 1", "functions where name == 'open",
])
def test_bad_queries_are_refused(text):
    with pytest.raises(QueryError):
        parse(text)


def test_bad_bindings_are_refused(views):
    for q in ("functions where unknown_predicate('x')", "functions where n in 3", "functions select sum(name) as s", "functions where has_method()", "classes"):
        with pytest.raises(QueryError):
            run(q, views)


def test_keywords_end_at_word_borders():
    q = parse("classes select order_id, ascii, notes where inherits_from == 'x' and not include in ['a'] order by descr desc")
    assert [x.name for x in q.select] == ["order_id", "ascii", "notes"] and q.order.path == "descr" and q.order.descending
    assert isinstance(q.where, Both) and isinstance(q.where.parts[1], Not)


_path = st.sampled_from(["a", "b.c", "in_x", "order_y"]).map(Path)
_literal = st.one_of(st.integers(-99, 99), st.booleans(), st.text("abc ", max_size=5), st.none()).map(Literal)
_leaf = st.builds(Compare, _path, st.sampled_from(["==", "!=", "<", "contains"]), _literal)
_tree = st.recursive(_leaf, lambda t: st.one_of(st.builds(Not, t), st.lists(t, min_size=2, max_size=3).map(lambda x: Both(tuple(x))), st.lists(t, min_size=2, max_size=3).map(lambda x: Either(tuple(x)))), max_leaves=8)


def written(n):
    if isinstance(n, Not):
        return f"not ({written(n.inner)})"
    if isinstance(n, (Both, Either)):
        return (" and " if isinstance(n, Both) else " or ").join(f"({written(p)})" for p in n.parts)
    v = n.right.value
    text = "null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"{n.left.name} {n.op} {text}"


@settings(max_examples=200, deadline=None)
@given(_tree)
def test_parsing_gives_back_what_was_written(tree):
    assert parse(f"functions where {written(tree)}").where == tree


def test_rows_iterate(views):
    assert [r["id"] for r in rows(run("functions select id order by id", views), "g")] == [1, 2, 3, 4]
    assert Aggregate("count", "*", "n").fn in AGGREGATES
