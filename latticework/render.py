"""DOT, Mermaid and Markdown text of results.  What is shown is cut to a number of rows first, in Spark, and says so; None shows all."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 500


def _shown(df: DataFrame, most: int | None, what: str) -> tuple[list, str | None]:
    """The rows, and how many of how many they are where some are left out."""
    if most is None:
        return df.collect(), None
    rows = df.limit(most + 1).collect()
    return rows[:most], f"{most} of {df.count()} {what}" if len(rows) > most else None


def _edges(edges: DataFrame, most: int | None) -> tuple[list, str | None]:
    return _shown(edges.select("src", "dst", "kind").orderBy("src", "dst", "kind"), most, "edges")


def _id(text: str) -> str:
    return "n_" + re.sub(r"\W", "_", text, flags=re.ASCII)


def _label(text: str, most: int = 40) -> str:
    name = text.rsplit("::", 1)[-1]
    return (name if len(name) <= most else name[: most - 1] + "…").replace('"', "'")


def dot(edges: DataFrame, cycles: DataFrame | None = None, most: int | None = MAX_ROWS) -> str:
    """A digraph; edges within one of the cycles (id, component) are red."""
    rows, cut = _edges(edges, most)
    group = {}
    if cycles is not None:
        names = sorted({x for r in rows for x in (r["src"], r["dst"])})
        group = {r["id"]: r["component"] for r in cycles.where(F.col("id").isin(names)).collect()}
    lines = ["digraph g {", "  rankdir=LR;"]
    lines += [f'  {_id(n)} [label="{_label(n)}"];' for n in sorted({x for r in rows for x in (r["src"], r["dst"])})]
    for r in rows:
        red = " [color=red]" if group.get(r["src"]) is not None and group.get(r["src"]) == group.get(r["dst"]) else ""
        lines.append(f"  {_id(r['src'])} -> {_id(r['dst'])}{red};")
    return "\n".join([*lines, *([f"  // {cut}"] if cut else []), "}"])


def mermaid(edges: DataFrame, most: int | None = MAX_ROWS) -> str:
    rows, cut = _edges(edges, most)
    lines = ["graph LR"]
    for r in rows:
        lines.append(f'  {_id(r["src"])}["{_label(r["src"])}"] -->|{r["kind"]}| {_id(r["dst"])}["{_label(r["dst"])}"]')
    return "\n".join([*lines, *([f"%% {cut}"] if cut else [])])


def markdown(df: DataFrame, most: int | None = 50) -> str:
    rows, cut = _shown(df, most, "rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows), *(["", cut] if cut else [])])
