"""Syntax tree -> Catalyst plan.

Logic is two-valued: a comparison with a missing value, an unknown path or
values of different types is false, and its negation true.  ``== null`` and
``!= null`` ask whether a value is missing.  Types are settled when the query
is bound, so nothing is cast row by row and filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grammar import Aggregate, Both, Call, Compare, Either, Literal, Not, Path, Query, QueryError

EPSILON = 2.220446049250313e-16


def _false() -> Column:
    return F.lit(False)


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(dtype, T.ArrayType):
        return "list"
    return "other"


class Binder:
    """Binds the names of one view."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.names = {f.name: f.dataType for f in df.schema}

    def find(self, path: str) -> tuple[Column, str] | None:
        for name in (path, path.replace(".", "_")):
            if name in self.names:
                return self.df[f"`{name}`"], kind_of(self.names[name])
        head, _, rest = path.partition(".")
        kind = self.names.get(head)
        column = self.df[f"`{head}`"] if kind is not None else None
        for part in rest.split(".") if rest else ():
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            column, kind = column[part], kind[part].dataType
        return (column, kind_of(kind)) if rest and kind is not None else None

    def value(self, node) -> tuple[Column | None, str]:
        """Column and kind; kind "missing" for what no row has."""
        if isinstance(node, Path):
            return self.find(node.name) or (None, "missing")
        if isinstance(node, Call):
            return F.coalesce(self.call(node), _false()), "bool"
        v = node.value
        if isinstance(v, bool):
            return F.lit(v), "bool"
        if isinstance(v, str):
            return F.lit(v), "text"
        if isinstance(v, int):
            return F.lit(v), "whole"
        if isinstance(v, float):
            return F.lit(v), "real"
        return None, "null" if v is None else "literal list"

    def call(self, node: Call) -> Column:
        """Predicates with arguments: names come as text or as a bare path."""
        text = [a.value if isinstance(a, Literal) else a.name if isinstance(a, Path) else None for a in node.args]

        def arity(n):
            if len(node.args) != n or any(not isinstance(t, str) for t in text):
                raise QueryError(f"{node.name} takes {n} name{'s' * (n > 1)}")

        if node.name == "contains":
            arity(2)
            return self.compare(Compare(Path(text[0]), "contains", Literal(text[1])))
        if node.name == "inherits_from":
            arity(1)
            return self._has(("mro_names", "inherits_from"), text[0])
        if node.name == "has_method":
            arity(1)
            return self._has(("method_names", "methods"), text[0])
        if node.name == "overrides_of":
            arity(1)
            return self._has(("overrides",), text[0])
        raise QueryError(f"unknown predicate {node.name}")

    def _has(self, columns: tuple[str, ...], name: str) -> Column:
        for c in columns:
            if (found := self.find(c)) and found[1] == "list":
                return F.coalesce(F.array_contains(found[0], name), _false())
        return _false()

    def condition(self, node) -> Column:
        if isinstance(node, Both):
            out = self.condition(node.parts[0])
            for p in node.parts[1:]:
                out = out & self.condition(p)
            return out
        if isinstance(node, Either):
            out = self.condition(node.parts[0])
            for p in node.parts[1:]:
                out = out | self.condition(p)
            return out
        if isinstance(node, Not):
            return ~self.condition(node.inner)
        return F.coalesce(self.compare(node), _false())

    def compare(self, node: Compare) -> Column:
        op = node.op
        if op == "in":
            if not (isinstance(node.right, Literal) and isinstance(node.right.value, list)):
                raise QueryError("in needs a list")
            out = _false()
            for x in node.right.value:
                out = out | F.coalesce(self.compare(Compare(node.left, "==", x)), _false())
            return out
        (a, ka), (b, kb) = self.value(node.left), self.value(node.right)
        if "null" in (ka, kb) and op in ("==", "!="):
            known = b if ka == "null" else a
            missing = F.lit(True) if known is None else known.isNull()
            return missing if op == "==" else ~missing
        if a is None or b is None:
            return _false()
        numbers = ka in ("whole", "real") and kb in ("whole", "real")
        if op in ("==", "!="):
            if numbers and "real" in (ka, kb):
                real = [x.value for x in (node.left, node.right) if isinstance(x, Literal)]
                exact = bool(real) and float(real[0]) == int(real[0])  # a whole number compares exactly and can be pushed down
                equal = a == b if exact else F.abs(a - b) < EPSILON
            elif numbers or (ka == kb and ka in ("text", "bool")):
                equal = a == b
            else:
                return _false()
            return equal if op == "==" else ~equal
        if op in ("<", "<=", ">", ">="):
            if not numbers:
                return _false()
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        if op == "contains":
            if ka == kb == "text":
                return F.contains(a, b)
            if ka == "list" and kb == "text":
                return F.exists(a, lambda x: F.contains(x.cast("string"), b))
            return _false()
        if ka == kb == "text":  # matches
            return F.regexp(a, b)
        return _false()


def label(path: str) -> str:
    """Column name of a path in a result: dots become underscores."""
    return path.replace(".", "_")


def _aggregate(binder: Binder, a: Aggregate) -> Column:
    if a.path == "*":
        return F.count(F.lit(1)).alias(a.alias)
    found = binder.find(a.path)
    column = found[0] if found else F.lit(None).cast("double")
    numeric = found and found[1] in ("whole", "real")
    if a.fn in ("sum", "avg") and found and not numeric:
        raise QueryError(f"{a.fn} of {a.path}, which is no number")
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.fn](column).alias(a.alias)


def bind(query: Query, df: DataFrame, key: str | None = "id") -> DataFrame:
    """The plan of a query over its view; key breaks ties of the order (columns left to right without one)."""
    binder = Binder(df)
    rows = df if query.where is None else df.where(binder.condition(query.where))
    aggregated = bool(query.group) or any(isinstance(x, Aggregate) for x in query.select)
    if aggregated:
        keys = [(f[0] if (f := binder.find(p)) else F.lit(None).cast("string")).alias(label(p)) for p in query.group]
        plain = [x for x in query.select if isinstance(x, Path) and x.name not in query.group]
        wanted = [_aggregate(binder, x) for x in query.select if isinstance(x, Aggregate)]
        wanted += [F.min(f[0] if (f := binder.find(x.name)) else F.lit(None).cast("string")).alias(label(x.name)) for x in plain]
        names = [x.alias if isinstance(x, Aggregate) else label(x.name) for x in query.select] or [label(p) for p in query.group]
        out = rows.groupBy(*keys).agg(*wanted) if wanted else rows.select(*keys).distinct()
        if query.order:
            name = label(query.order.path)
            ties = [c for c in [label(p) for p in query.group] if c != name]
            if name in out.columns:
                first = F.col(f"`{name}`")
                out = out.orderBy(first.desc_nulls_last() if query.order.descending else first.asc_nulls_last(), *ties)
        out = out.select(*[F.col(f"`{n}`") for n in dict.fromkeys(names)])
        return out if query.limit is None else out.limit(query.limit)
    if query.order or query.limit is not None:
        order = []
        if query.order and (found := binder.find(query.order.path)):
            order.append(found[0].desc_nulls_last() if query.order.descending else found[0].asc_nulls_last())
        sortable = [c for c, t in binder.names.items() if kind_of(t) != "other" or isinstance(t, T.TimestampType)]
        order += [df[f"`{c}`"] for c in ([key] if key in binder.names else sortable)]
        rows = rows.orderBy(*order)
    if query.limit is not None:
        rows = rows.limit(query.limit)
    if not query.select:
        return rows
    picked = {label(x.name): (f[0] if (f := binder.find(x.name)) else F.lit(None).cast("string")) for x in query.select}
    return rows.select(*[c.alias(n) for n, c in picked.items()])
