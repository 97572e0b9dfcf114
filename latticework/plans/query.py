"""Running a query text over views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from .binder import bind
from .grammar import QueryError, parse, referenced


View = DataFrame | Callable[[frozenset[str] | None], DataFrame]


def run(text: str, views: dict[str, View], key: str | None = "id") -> DataFrame:
    """The lazy result of a query over the view of its entity.

    A view may be a function of the column names that the query reads (None for
    all): it leaves out the joins and aggregates that the query doesn't need.
    """
    q = parse(text)
    if q.entity not in views:
        raise QueryError(f"no view of {q.entity}")
    view = views[q.entity]
    return bind(q, view if isinstance(view, DataFrame) else view(referenced(q)), key)


def with_joins(base: DataFrame, names: frozenset[str] | None, joins: list) -> DataFrame:
    """base left-joined with those of (key columns, columns it adds, function that makes it, default) whose columns are read."""
    for keys, adds, make, default in joins:
        if names is None or names & set(adds):
            base = base.join(make(), keys, "left")
            if default is not None:
                base = base.fillna(default, [c for c in adds if c in base.columns])
    return base


def rows(df: DataFrame, group: str | None = None) -> Iterator[dict]:
    """Rows one partition at a time; with group, SparkContext.cancelJobGroup(group) stops them."""
    if group:
        df.sparkSession.sparkContext.setJobGroup(group, "query", interruptOnCancel=True)
    for r in df.toLocalIterator():
        yield r.asDict(recursive=True)
