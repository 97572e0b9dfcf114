"""python -m latticework.cli: analyze a tree into a catalogue folder, then ask it.

    analyze ROOT --out DIR [--ignore PATTERN ...]
    query|find|traverse|callers|callees|affected|chain|children|smells|stats|plan|draw --catalog DIR ...
    changed|blame|clean ROOT ...
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import render
from .catalog import GraphCatalog
from .cluster import clean
from .operators import graph, search
from .sources import git


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latticework", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--rows", type=int, default=50, help="rows shown, 0 for all; a drawing shows ten times as many")
    sub = p.add_subparsers(dest="command", required=True)
    a =sub.add_parser("analyze")
    a.add_argument("root")
    a.add_argument("--out", required=True)
    a.add_argument("--ignore", nargs="*", default=[])

    def on(name, *args):
        s = sub.add_parser(name)
        s.add_argument("--catalog", required=True)
        for x in args:
            s.add_argument(x)
        return s

    on("query", "text")
    f = on("find", "name")
    f.add_argument("--kind")
    f.add_argument("--top", type=int, default=10)
    t = on("traverse", "id")
    t.add_argument("--depth", type=int, default=3)
    t.add_argument("--kinds", nargs="*")
    t.add_argument("--direction", default="downstream")
    for name in ("callers", "callees", "children"):
        on(name, "id")
    on("affected", "id").add_argument("--depth", type=int, default=5)
    on("chain", "start", "end")
    s = on("smells")
    s.add_argument("--entity")
    s.add_argument("--rule")
    on("stats")
    on("plan", "question")
    d = on("draw")
    d.add_argument("--kind", default="calls")
    d.add_argument("--form", choices=("dot", "mermaid"), default="mermaid")
    c = sub.add_parser("changed")
    c.add_argument("root")
    c.add_argument("old")
    c.add_argument("new", nargs="?", default="HEAD")
    b = sub.add_parser("blame")
    b.add_argument("root")
    b.add_argument("path")
    sub.add_parser("clean").add_argument("root")
    return p


def run(spark: SparkSession, argv: list[str]) -> str:
    o = parser().parse_args(argv)
    most = None if o.rows == 0 else o.rows
    if o.command == "analyze":
        c = GraphCatalog.analyze(spark, o.root, o.ignore)
        c.save(o.out)
        return render.markdown(c.entities.groupBy("kind").count().orderBy("kind"))
    if o.command == "changed":
        return render.markdown(git.changed_files(spark, o.root, o.old, o.new), most)
    if o.command == "blame":
        return render.markdown(git.blame(spark, o.root, o.path), most)
    if o.command == "clean":
        return "clean" if git.is_clean(o.root) else "changed"
    c = GraphCatalog.load(spark, o.catalog)
    if o.command == "draw":
        edges = c.edges.where(f"kind = '{o.kind}'") if o.kind.isidentifier() else c.edges.limit(0)
        wide = most and 10 * most
        return render.mermaid(edges, wide) if o.form == "mermaid" else render.dot(edges, graph.strong_components(edges), wide)
    made = {
        "query": lambda: c.query(o.text), "find": lambda: c.find(o.name, o.top, o.kind).select("id", "kind", "score"), "traverse": lambda: c.traverse(o.id, o.depth, o.kinds, o.direction).orderBy("depth", "id"),
        "callers": lambda: c.callers_of(o.id).select("id", "kind", "path", "line"), "callees": lambda: c.callees_of(o.id).select("id", "kind", "path", "line"), "children": lambda: c.module_children(o.id).select("id", "kind", "line").orderBy("line"),
        "affected": lambda: c.affected(o.id, o.depth).orderBy("depth"), "chain": lambda: c.call_chain(o.start, o.end).orderBy("pos"), "smells": lambda: c.smells(o.entity, o.rule), "stats": c.stats,
        "plan": lambda: search.plan(spark.createDataFrame([(o.question,)], "question string")),
    }
    return render.markdown(made[o.command](), most)


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("latticework").getOrCreate()
    print(run(spark, sys.argv[1:]))
    clean(spark)


if __name__ == "__main__":
    main()
