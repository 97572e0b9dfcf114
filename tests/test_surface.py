"""Command line, settings, cache and git."""

import subprocess

import pytest

from latticework import cli, config, queries, render
from latticework.cache import QueryCache
from latticework.sources import git


def test_command_line(spark, tmp_path):
    for path, text in queries.SOURCES.items():
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(text)
    at = ["--catalog", str(tmp_path / "cat")]
    assert "| function | 9 |" in cli.run(spark, ["analyze", str(tmp_path / "src"), "--out", str(tmp_path / "cat")])
    for argv, part in (
        (["query", *at, "classes select name where method_count > 1"], "Item"), (["find", *at, "total"], "shop/base.py::total"), (["callers", *at, "shop/base.py::total"], "shop/book.py::sell"), (["traverse", *at, "shop/book.py::sell", "--depth", "1"], "shop/base.py::total"),
        (["affected", *at, "shop/base.py::total"], "| 1 |"), (["stats", *at], "overrides"), (["draw", *at], "graph LR"), (["draw", *at, "--form", "dot"], "digraph"), (["plan", *at, "who calls total"], "impact"), (["children", *at, "shop/book.py::module"], "Book"), (["smells", *at], "rule_id"),
    ):
        assert part in cli.run(spark, argv), argv


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("ignore = ['x']\n[querying]\ntop_k = 3\ncache_seconds = 5\n")
    c = config.load(str(tmp_path / "c.toml"))
    assert c.querying.top_k == 3 and c.querying.cache_seconds == 5.0 and c.ignore == ["x"] and c.editing.max_files == 100
    for bad in ("nope = 1", "[querying]\ntop_k = 'x'", "[querying]\nnope = 1"):
        (tmp_path / "b.toml").write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / "b.toml"))


def test_cache(spark):
    now = [0.0]
    c = QueryCache(2, 10, lambda: now[0])
    get = lambda p, v=1: c.rows("q", {"p": p}, v, lambda: spark.range(p))
    assert len(get(3)) == 3 and get(3) and c.hits == 1 and get(3, 2) and c.misses == 2
    now[0] = 11
    get(3)
    assert c.misses == 3 and c.hit_rate == 0.25
    get(4)
    assert len(c.kept) == 2
    assert sum(1 for _ in get(10_001)) == 10_001 and len(c.kept) == 2  # all rows, not kept


def test_a_cut_is_told(spark):
    df = spark.range(51).selectExpr("id", "concat('a', id) as src", "concat('b', id) as dst", "'calls' as kind")
    assert render.markdown(df.where("id < 50")).count("\n") == 51 and render.markdown(df).endswith("\n\n50 of 51 rows") and render.markdown(df, None).count("\n") == 52
    assert render.mermaid(df, 50).endswith("%% 50 of 51 edges") and "// 50 of 51 edges" in render.dot(df, most=50) and render.mermaid(df, None).count("-->") == 51


def test_git(spark, tmp_path):
    def sh(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)

    sh("init", "-b", "main")
    (tmp_path / "a b.py").write_text("x = 1\ny = 2\n")
    sh("add", ".")
    sh("commit", "-m", "one")
    assert git.is_clean(str(tmp_path)) and git.branch(str(tmp_path)) == "main"
    (tmp_path / "a b.py").write_text("x = 1\ny = 3\n")
    (tmp_path / "c.py").write_text("")
    assert not git.is_clean(str(tmp_path))
    sh("add", ".")
    sh("commit", "-m", "two")
    assert sorted(map(tuple, git.changed_files(spark, str(tmp_path), "HEAD~1").collect())) == [("A", "c.py"), ("M", "a b.py")]
    lines = git.blame(spark, str(tmp_path), "a b.py").orderBy("line").collect()
    assert [r.line for r in lines] == [1, 2] and lines[0].commit != lines[1].commit and lines[0].author == "n"
