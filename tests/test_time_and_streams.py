import json
import shutil
import subprocess
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from latticework.functions import text as tx
from latticework.operators import diff, search, temporal
from latticework.streaming import incremental as inc

ROOT = Path(__file__).resolve().parent.parent


def ts(day):
    return datetime(2024, 1, day)


def test_ledger_versions_and_retirement(spark, tmp_path):
    e = spark.createDataFrame([("a", "b", "calls"), ("a", "external::x", "calls")], "src string, dst string, kind string")
    temporal.append(temporal.assertions(e, ts(2)), str(tmp_path / "l"))
    later = spark.createDataFrame([("a", "c", "calls")], e.schema)
    temporal.append(temporal.assertions(later, ts(5)), str(tmp_path / "l"))
    read = lambda: spark.read.parquet(str(tmp_path / "l")).drop("tx_day")
    temporal.append(temporal.retire(read(), e, temporal.EDGE_KEY, ts(7)), str(tmp_path / "l"))
    at = lambda d: {r.dst for r in temporal.as_of(read(), temporal.EDGE_KEY, ts(d)).collect()}
    assert [at(d) for d in (1, 2, 5, 7)] == [set(), {"b"}, {"b", "c"}, {"c"}]
    line = temporal.timeline(read().where("dst = 'b'"), temporal.EDGE_KEY).orderBy("valid_from").collect()
    assert [(r.valid_from, r.valid_to.year, r.retired) for r in line] == [(ts(2), 2024, False), (ts(7), 9999, True)]
    assert {r.id for r in temporal.traverse_at(read(), "a", ts(3)).collect()} == {"a", "b"}
    assert {r.id for r in temporal.traverse_at(read(), "c", ts(6), direction="upstream").collect()} == {"a", "c"}
    assert {r.dst for r in temporal.reconstruct(read(), temporal.EDGE_KEY, ts(6)).collect()} == {"b", "c"}


def test_as_of_join_keeps_left_rows(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("x", 5, "q"), ("y", 9, "r"), (None, 3, "s")], "k string, t int, v string")
    b = spark.createDataFrame([("x", 2, 10), ("x", 5, 11), ("x", 5, 12), ("z", 1, 13)], "k string, t int, w int")
    assert sorted(map(str, (tuple(r) for r in temporal.as_of_join(a, b, ["k"], "t", "t", "w", "last").collect()))) == sorted(map(str, [("x", 1, "p", None), ("x", 5, "q", 12), ("y", 9, "r", None), (None, 3, "s", None)]))


def test_stream_equals_full_rebuild(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(n, *changes):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"path": p, "text": t, "ts": f"2024-01-01T00:00:{s:02}Z"}) for p, t, s in changes))

    store = inc.UnitStore(spark, f"file://{tmp_path}/units")
    seen = []

    def go():
        inc.follow(inc.read_changes(spark, str(src)), store, str(tmp_path / "cp"), once=True, on_diff=lambda i, d: seen.extend(map(tuple, d.select("qualified_name", "op", "change").where("kind = 'function'").collect()))).awaitTermination()
        return {r.id for r in store.current().where("kind = 'function'").collect()}

    put(1, ("a.py", "def f(): pass\ndef g(): pass", 1), ("b.py", "def h(): pass", 1), ("a.py", "old", 0), ("node_modules/c.py", "def no(): pass", 1))
    assert go() == {"a.py::f", "a.py::g", "b.py::h"}
    put(2, ("a.py", "def f(): return 1\ndef k(x): pass", 2), ("b.py", None, 3))
    assert go() == {"a.py::f", "a.py::k"}
    assert sorted(seen, key=str) == [("f", "modify", "body"), ("g", "remove", None), ("h", "remove", None), ("k", "insert", None)]
    before = store._versions()
    store.upsert(spark.createDataFrame([("z.py", "def z(): pass", ts(1))], inc.CHANGE), before[-1])
    assert store._versions() == before  # a batch that runs again changes nothing
    store.compact()
    assert len(store._versions()) == 1 and {r.id for r in store.current().where("kind = 'function'").collect()} == {"a.py::f", "a.py::k"}
    store.upsert(spark.createDataFrame([("z.py", "def z(): pass", ts(1)), ("a.py", None, ts(1))], inc.CHANGE), 99)
    assert {r.id for r in store.current().where("kind = 'function'").collect()} == {"z.py::z"}


def test_own_writes_are_suppressed(spark):
    c = spark.createDataFrame([("a.py", "x", datetime(2024, 1, 1, 0, 0, 3)), ("a.py", "y", datetime(2024, 1, 1, 0, 0, 3)), ("a.py", "x", datetime(2024, 1, 1, 0, 0, 9))], inc.CHANGE)
    w = spark.createDataFrame([("a.py", "x", datetime(2024, 1, 1))], inc.CHANGE).select("path", tx.content_digest("text").alias("content_hash"), "ts")
    assert sorted((r.text, r.ts.second) for r in inc.suppressed(c, w).collect()) == [("x", 9), ("y", 3)]


def test_windows_on_a_stream(spark, tmp_path):
    spark.range(100).selectExpr("cast(timestamp_seconds(1704067200 + id * 3600) as timestamp) as ts", "if(id % 2 = 0, 'a', 'b') as event_type", "id % 3 as user_id").write.parquet(str(tmp_path / "e"))
    df = spark.read.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = inc.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, inc.windowed_counts(df).collect()))
    assert inc.sessions(df, "2 hours").count() == 100


def test_affected_and_dangling(spark):
    e = spark.createDataFrame([("a.py::f", "b.py::g", "calls"), ("c.py::h", "a.py::f", "calls"), ("a.py::f", "external::p", "calls")], "src string, dst string, kind string")
    assert [r.path for r in diff.affected_files(e, spark.createDataFrame([("b.py",)], "path string")).collect()] == ["a.py"]
    left = diff.dangling(e, spark.createDataFrame([("a.py::f",), ("c.py::h",)], "id string"))
    assert sorted(r.dst for r in left.collect()) == ["a.py::f", "external::p"]


def test_scalar_functions(spark):
    one = spark.createDataFrame([("x",)], "s string")
    get = lambda *c: tuple(one.select(*c).first())
    L = F.lit
    assert get(tx.normal_path(L("./a\\b.py")), tx.stem(L("a/b.c.py")), tx.stem(L("a/.env")), tx.id_path(L("a::b.py::C.m")), tx.id_name(L("a.py::C.m"))) == ("a/b.py", "b.c", ".env", "a::b.py", "m")
    arr = lambda *v: F.array(*map(L, v))
    assert get(tx.cosine(arr(1.0, 0.0), arr(1.0, 0.0)), tx.cosine(arr(1.0), arr(1.0, 2.0)), tx.cosine(arr(0.0), arr(1.0))) == (1.0, 0.0, 0.0)
    assert get(tx.query_spelling(L("mod:fn/3 kind:class")), tx.token_estimate(L("")), tx.token_estimate(L("x" * 9))) == ("mod.fn kind:class", 1, 2)
    assert get(tx.joined_route(L("/a/"), L("b/")), tx.joined_route(L(None).cast("string"), L("/")), tx.controller_route(L("api/[controller]"), L("UsersController"))) == ("/a/b", "/", "api/users")
    assert get(tx.flag(L(3), 0), tx.flag(L(1), 0), tx.flag(L(0), 0), tx.flag(L(12), 2)) == (True, False, None, True)
    assert get(tx.path_score(L(1), L(1), L(0)), tx.path_score(L(20), L(0), L(0)), tx.unquoted(L("'q'")), tx.leading_dots(L("..a"))) == (0.96, 0.9, "q", 2)
    assert get(tx.indent_style(L("a\n  b\n    c\n  d")), tx.indent_style(L("a\n\tb")), tx.indent_style(L("a"))) == ("2", "tab", "4")
    assert [tuple(r) for r in get(tx.line_diff(L("a\nb"), L("a\nc\nd")))[0]] == [(2, "b", "c"), (3, None, "d")]
    assert get(tx.short_label(L("abcdef"), 4), tx.dot_id(L("a b"))) == ("abc…", "n_a_b")


def test_embedding_dedup_by_content(spark):
    e = spark.createDataFrame([("1", "h", "x"), ("2", "h", "x"), ("3", "k", "yy")], "id string, content_hash string, source string")
    v = spark.createDataFrame([("3", "old", [9.0])], "id string, content_hash string, embedding array<double>")
    out = search.embed(e, v, lambda texts: [[float(len(t))] for t in texts], 1)
    assert sorted((r.id, r.embedding) for r in out.collect()) == [("1", [1.0]), ("2", [1.0]), ("3", [2.0])]


def test_engine_works_without_the_optional_folders(tmp_path):
    for name in ("latticework", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "latticework" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, timeout=120)
