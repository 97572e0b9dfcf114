import random

import pytest
from pyspark.sql import functions as F

from latticework import cluster, queries
from latticework.operators import graph, mro, resolve, search

from .oracle import compare


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "src string, dst string, kind string")


def walk(df):
    return {r.id: r.depth for r in df.collect()}


def test_chain_cycle_and_diamond(spark):
    e = edges(spark, ["ab", "bc", "ca", "ad", "bd"])
    assert walk(graph.traverse(e, "a", 1)) == {"a": 0, "b": 1, "d": 1}
    assert walk(graph.traverse(e, "a", 9)) == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert walk(graph.traverse(e, "c", 2, ["calls"], "upstream")) == {"c": 0, "b": 1, "a": 2}
    assert walk(graph.traverse(e, "d", 1, direction="both")) == {"d": 0, "a": 1, "b": 1}
    assert walk(graph.traverse(e, "a", 0)) == walk(graph.traverse(e, "a", 5, [])) == {"a": 0}


def test_kinds_directions_and_unknown_starts(spark):
    e = edges(spark, ["ab"], "extends").unionByName(edges(spark, ["ac"], "handles"))
    assert walk(graph.traverse(e, "a", 2, ["Inherits"])) == {"a": 0, "b": 1}
    assert walk(graph.traverse(e, "a", 2, ["calls"])) == {"a": 0, "c": 1}
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    assert walk(graph.traverse(e, "a", 2, None, "out", known)) == {"a": 0, "b": 1}
    assert walk(graph.traverse(e, "x", 2, None, "out", known)) == {}
    with pytest.raises(ValueError):
        graph.traverse(e, "a", 1, None, "sideways")


def test_ties_go_by_parent_then_kind_then_id(spark):
    e = spark.createDataFrame([("s", "b", "calls"), ("s", "a", "imports"), ("a", "t", "calls"), ("b", "t", "imports"), ("b", "t", "extends")], "src string, dst string, kind string")
    got = {r.id: r.edge_type for r in graph.traverse(e, "s", 2).collect()}
    assert got == {"s": "", "b": "calls", "a": "imports", "t": "extends"}  # b was found first, by its kind


def test_closure_and_paths_equal_brute_force(spark):
    rng = random.Random(2)
    names = [f"n{i:02}" for i in range(25)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(50)})
    out = {}
    for root in names:
        seen, level = {root: 0}, [root]
        for depth in range(1, 5):
            level = sorted({b for a, b in pairs if a in level} - set(seen))
            seen |= dict.fromkeys(level, depth)
        out |= {(root, k): v for k, v in seen.items()}
    e = edges(spark, pairs)
    starts = spark.createDataFrame([(n,) for n in names], "id string")
    assert {(r.root, r.id): r.depth for r in graph.closure(e, starts, 4).collect()} == out
    start, end = next(k for k, v in sorted(out.items()) if v >= 3)
    path = [r.id for r in graph.shortest_path(e, start, end, 6).orderBy("pos").collect()]
    assert path[0] == start and path[-1] == end and len(path) == out[start, end] + 1 and all((a, b) in pairs for a, b in zip(path, path[1:]))
    assert graph.shortest_path(e, start, "nowhere", 6).count() == 0
    assert [r.id for r in graph.shortest_path(e, "n01", "n01").collect()] == ["n01"]


@pytest.mark.parametrize("seed", range(2))
def test_strong_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(20)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(28)})
    reach = {n: {n} for n in names}
    for _ in names:
        for a, b in pairs:
            reach[a] |= reach[b]
    seen = {x for p in pairs for x in p}
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in seen}
    assert {r.id: r.component for r in graph.strong_components(edges(spark, pairs)).collect()} == want


def test_unresolved_and_degrees(spark):
    e = edges(spark, ["ab", "ab", "cb"])
    open_ = edges(spark, [("a", "x"), ("b", "y"), ("c", "z")])
    assert graph.unresolved_count(e, open_, "a", 3).first().n == 2 and graph.unresolved_count(e, open_, "b", 3, None, "upstream").first().n == 0
    got = {r.id: (r.caller_count, r.callee_count, r.callers) for r in graph.degrees(e).collect()}
    assert got == {"a": (0, 1, []), "b": (2, 0, ["a", "c"]), "c": (0, 1, [])}


def test_tasks_that_drop_repeated_pairs_grow_in_number_not_in_size(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(cluster, "ROWS", 200, raising=False)
    for of in (queries.call_edges, queries.import_edges):
        each = of(spark, sf_dir).groupBy(F.spark_partition_id().alias("at")).count().collect()
        assert len(each) > 20 and max(r["count"] for r in each) < 600  # of 6,000 rows in 30 partitions
    compare(spark, queries.QUERIES["graph_stats"], queries.SQL["graph_stats"], sf_dir)


def test_c3_agrees_with_python():
    rng = random.Random(0)
    for _ in range(300):
        bases, made, sound = {"A0": []}, {"A0": type("A0", (), {})}, True
        for i in range(1, 7):
            own = rng.sample(sorted(made), rng.randrange(0, min(3, len(made)) + 1))
            try:
                made[f"A{i}"] = type(f"A{i}", tuple(made[b] for b in own), {})
                bases[f"A{i}"] = own
            except TypeError:
                assert mro.linearise(f"A{i}", bases | {f"A{i}": own})[1]
                sound = False
        for name, cls in made.items():
            assert mro.linearise(name, bases) == ([c.__name__ for c in cls.__mro__[:-1]], False), sound


def test_a_chain_of_150_classes_keeps_all_ancestors(spark):
    b = spark.createDataFrame([(f"c{i:03}", [f"c{i - 1:03}"] if i else []) for i in range(150)], "class_id string, bases array<string>")
    top = mro.orders(b).where("class_id = 'c149'").first()
    assert top.mro == [f"c{i:03}" for i in reversed(range(150))] and not top.mro_error


def test_nearest_equals_brute_force(spark, monkeypatch):
    from latticework.functions.text import cosine

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(60)] + [(60 + i, [1.0, 2.0, 2.0]) for i in range(5)] + [(70, None), (71, [0.0, 0.0, 0.0]), (72, [1.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(search, "QUERIES", 4)
    monkeypatch.setattr(search, "ROWS", 7)
    got = search.nearest(v.where("id % 7 = 0"), v, 8).collect()
    pairs = v.where("id % 7 = 0").toDF("query", "e").crossJoin(v).withColumn("s", cosine(F.col("embedding"), F.col("e"))).collect()
    for q in {r.query for r in pairs}:
        want = sorted((-round(r.s or 0.0, 9), r.id) for r in pairs if r.query == q)[:8]
        found = sorted((-r.similarity, r.id) for r in got if r.query == q)
        assert [i for _, i in found] == [i for _, i in want] and [x for x, _ in found] == pytest.approx([x for x, _ in want], abs=1e-8)
    assert search.nearest(v.limit(0), v).count() == 0 and search.nearest(v, v.limit(0)).count() == 0


def test_suffix_shared_by_many_modules(spark):
    m = spark.range(20_000).selectExpr("cast(id as string) as id", "concat('p', id, '/utils.py') as path")
    w = spark.range(2_000).selectExpr("cast(id as string) as key", "if(id % 2 = 0, 'utils', concat('p', id, '.utils')) as dotted")
    got = dict(resolve.longest_suffix(w, m).collect())
    assert len(got) == 2_000 and all(got[str(i)] == (str(i) if i % 2 else "0") for i in range(2_000))


def test_suffixes_need_a_folder_border(spark):
    m = spark.createDataFrame([("1", "lib/xutils.py"), ("2", "lib/utils.py"), ("3", "app/lib/utils.ts"), ("4", "pkg/__init__.py"), ("5", "src/ui/card.ts")], "id string, path string")
    w = spark.createDataFrame([("a", "utils"), ("b", "app.lib.utils"), ("c", "other.utils"), ("d", "pkg"), ("e", "missing"), ("f", "@/ui/card"), ("g", None)], "key string, dotted string")
    assert dict(resolve.longest_suffix(w, m).collect()) == {"a": "2", "b": "3", "c": "2", "d": "4", "f": "5"}


def test_signatures_decline_common_names(spark):
    f = spark.createDataFrame([(f"f{i}", "run", [1] * 2, "a/b.py") for i in range(501)] + [("g1", "go", [1], "a/b.py"), ("g2", "go", [1, 1, 1], "a/c.py"), ("g3", "go", [1], "z/c.py")], "id string, name string, parameters array<int>, path string")
    w = spark.createDataFrame([("k1", "run", 2, "a/x.py"), ("k2", "go", 1, "a/x.py"), ("k3", "none", 1, "a/x.py")], "key string, name string, arity int, path string")
    got = {r.key: (r.target, round(r.score, 3), round(r.confidence, 3)) for r in resolve.signature_matches(w, f).collect()}
    assert got == {"k2": ("g1", 1.0, 0.79)}
