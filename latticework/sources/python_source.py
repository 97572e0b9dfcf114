"""Python source files -> one row a unit (module, class, function, import, field, constant, type alias).

The standard library's parser runs in mapInArrow over whole files, one file a
row; a file that doesn't parse gives its module row with the error.  Spans are
half-open byte offsets into the UTF-8 text.
"""

from __future__ import annotations

import ast
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from latticework.cluster import ship
from latticework.schema import BUILTIN_TYPES, SELF_NAMES, STOPLIST, UNIT

_LITERAL = (ast.Constant, ast.Dict, ast.DictComp, ast.JoinedStr, ast.List, ast.ListComp, ast.Set, ast.SetComp, ast.Tuple)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def metrics(node: ast.AST, lines: list[str]) -> tuple[int, int, int]:
    """(cyclomatic complexity, nesting depth, returns) of a function, nested functions included.

    An elif counts a branch and stands one level below its if, as do else,
    except and finally below their statement; the items of a with stand two
    levels deep; boolean operators and comprehensions count nothing.
    """
    branches, deepest, returns = 1, 0, 0
    stack: list[tuple[ast.AST, int]] = [(node, 0)]
    while stack:
        n, depth = stack.pop()
        deepest = max(deepest, depth)
        inner, later = depth, []
        if isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar)):
            inner = depth + 1
            branches += not isinstance(n, (ast.Try, ast.TryStar))
            tail = n.orelse
            if isinstance(n, ast.If) and len(tail) == 1 and isinstance(tail[0], ast.If) and lines[tail[0].lineno - 1].encode()[tail[0].col_offset :].startswith(b"elif"):
                chain = tail[0]
                while True:  # every elif of a chain stands one level below the first if
                    branches += 1
                    deepest = max(deepest, inner + 1)
                    later += [(x, inner + 1) for x in [chain.test, *chain.body]]
                    rest = chain.orelse
                    if len(rest) == 1 and isinstance(rest[0], ast.If) and lines[rest[0].lineno - 1].encode()[rest[0].col_offset :].startswith(b"elif"):
                        chain = rest[0]
                        continue
                    tail = rest
                    break
            own = [x for f in ("test", "target", "iter") if (x := getattr(n, f, None)) is not None]
            later += [(x, inner) for x in [*own, *n.body]]
            for part in (tail, getattr(n, "finalbody", [])):
                if part:
                    deepest = max(deepest, inner + 1)
                    later += [(x, inner + 1) for x in part]
            for h in getattr(n, "handlers", []):
                branches += 1
                deepest = max(deepest, inner + 1)
                later += [(x, inner + 1) for x in [*([h.type] if h.type else []), *h.body]]
        elif isinstance(n, (ast.With, ast.AsyncWith)):
            inner = depth + 1
            deepest = max(deepest, depth + 2)
            later = [*((x, depth + 2) for x in n.items), *((x, inner) for x in n.body)]
        elif isinstance(n, (ast.IfExp, ast.match_case)):
            inner, branches = depth + 1, branches + 1
            later = [(x, inner) for x in ast.iter_child_nodes(n)]
        else:
            returns += isinstance(n, ast.Return)
            children = ast.iter_child_nodes(n)
            if n is node and isinstance(n, _FUNCTION):
                children = [x for x in children if x not in n.decorator_list]
            later = [(x, depth) for x in children]
        deepest = max(deepest, inner)
        stack += later
    return branches, deepest, returns


def exports(tree: ast.Module) -> list[str] | None:
    """Names in __all__, by assignment, +=, append and extend, first seen first; None without any."""
    out: list[str] | None = None

    def add(node):
        nonlocal out
        parts = node.elts if isinstance(node, (ast.List, ast.Tuple, ast.Set)) else [node]
        out = (out or []) + [p.value for p in parts if isinstance(p, ast.Constant) and isinstance(p.value, str)]

    for n in tree.body:
        target = n.targets[0] if isinstance(n, ast.Assign) and len(n.targets) == 1 else getattr(n, "target", None)
        if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and isinstance(target, ast.Name) and target.id == "__all__" and n.value is not None:
            if isinstance(n, (ast.Assign, ast.AnnAssign)):
                out = []
            add(n.value)
        elif isinstance(n, ast.Expr) and isinstance(n.value, ast.Call) and isinstance(f := n.value.func, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id == "__all__" and f.attr in ("append", "extend") and n.value.args:
            add(n.value.args[0])
    return None if out is None else list(dict.fromkeys(out))


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def _annotation(node: ast.AST | None) -> str | None:
    text = _text(node)
    return None if text in BUILTIN_TYPES else text


class _Units(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.lines = text.split("\n")
        starts = [0]
        for x in self.lines:
            starts.append(starts[-1] + len(x.encode("utf-8", "surrogatepass")) + 1)
        self.starts = starts
        self.module = f"{path}::module"
        self.rows: list[dict] = []
        self.quals: list[str] = []
        self.classes: list[dict] = []
        self.functions: list[dict] = []
        self.guarded = 0

    def span(self, first: ast.AST, last: ast.AST | None = None) -> dict:
        last = last or first
        return {"start": self.starts[first.lineno - 1] + first.col_offset, "end": self.starts[last.end_lineno - 1] + last.end_col_offset}

    def add(self, kind: str, name: str, node: ast.AST, **more) -> dict:
        qual = ".".join([*self.quals, name])
        source = ast.get_source_segment(self.text, node) or ""
        row = {
            "kind": kind, "id": f"{self.path}::{qual}", "name": name, "qualified_name": qual, "path": self.path, "language": "Python", "parent_module": self.module,
            "parent_class": self.classes[-1]["id"] if self.classes else None, "parent_function": self.functions[-1]["id"] if self.functions else None,
            "line": node.lineno, "exit_line": node.end_lineno, "source": source, "content_hash": digest(source), "span": self.span(node), "is_type_only": bool(self.guarded),
        } | more
        self.rows.append(row)
        return row

    def name_span(self, node: ast.AST, word: str) -> dict:
        at = self.starts[node.lineno - 1] + node.col_offset
        raw = self.text.encode("utf-8", "surrogatepass")
        start = raw.index(node.name.encode(), raw.index(word.encode(), at) + len(word))
        return {"start": start, "end": start + len(node.name.encode())}

    def visit_ClassDef(self, node):
        marks = [_text(d) for d in node.decorator_list]
        bases = [b for b in (_text(x.value if isinstance(x, ast.Subscript) else x) for x in node.bases) if b not in BUILTIN_TYPES]
        row = self.add("class", node.name, node, bases=bases, decorators=marks, docstring=ast.get_docstring(node), fields=[], grammar_kind="class_definition",
                       name_span=self.name_span(node, "class"), body_span=self.span(node.body[0], node.body[-1]), is_dataclass=any("dataclass" in m for m in marks))
        self.quals.append(node.name)
        self.classes.append(row)
        outer, self.functions = self.functions, []
        for x in node.body:
            if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
                found = [(x.target.id, _text(x.annotation), _text(x.value), "ClassVar" in (_text(x.annotation) or ""))]
            elif isinstance(x, ast.Assign):
                found = [(t.id, None, _text(x.value), True) for t in x.targets if isinstance(t, ast.Name)]
            else:
                found = []
            for name, kind, value, shared in found:
                row["fields"].append({"name": name, "type_annotation": kind, "default_value": value, "is_class_var": shared, "line": x.lineno})
            self.visit(x)
        self.functions = outer
        self.classes.pop()
        self.quals.pop()

    def visit_FunctionDef(self, node):
        marks = [_text(d) for d in node.decorator_list]
        a = node.args
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + a.defaults
        params = [(p, d, False, False) for p, d in zip(plain, defaults)]
        if a.vararg:
            params.append((a.vararg, None, True, False))
        params += [(p, d, False, False) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
        if a.kwarg:
            params.append((a.kwarg, None, False, True))
        parameters = [{"name": p.arg, "annotation": _annotation(p.annotation), "default_value": _text(d), "is_varargs": v, "is_kwargs": k} for p, d, v, k in params]
        method = bool(self.classes) and not self.functions
        kind = "Method" if method else "Nested" if self.functions else "Free"
        for m in marks:
            if method:
                kind = {"staticmethod": "StaticMethod", "classmethod": "ClassMethod", "property": "Property", "cached_property": "Property", "functools.cached_property": "Property"}.get(m, "Setter" if m.endswith(".setter") else kind)
        cyclomatic, nesting, returns = metrics(node, self.lines)
        own = [x for x in ast.walk(node) if isinstance(x, (ast.Yield, ast.YieldFrom))]
        body = "\n".join(ast.unparse(x) for x in node.body)
        signature = ast.unparse(a) + " -> " + (_text(node.returns) or "") + " " + " ".join(marks)
        row = self.add(
            "function", node.name, node, decorators=marks, docstring=ast.get_docstring(node), parameters=parameters, return_type=_annotation(node.returns), calls=[], value_refs=[], function_kind=kind,
            is_async=isinstance(node, ast.AsyncFunctionDef), is_generator=bool(own), cyclomatic=cyclomatic, nesting_depth=nesting, return_count=returns,
            signature_hash=digest(signature), body_hash=digest(body), name_span=self.name_span(node, "def"), body_span=self.span(node.body[0], node.body[-1]),
        )
        self.quals.append(node.name)
        self.functions.append(row)
        for x in [*a.defaults, *(d for d in a.kw_defaults if d), *node.body]:
            self.visit(x)
        self.functions.pop()
        self.quals.pop()

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node):
        if self.functions:
            f = node.func
            if isinstance(f, ast.Name) and f.id not in STOPLIST:
                self.functions[-1]["calls"].append({"name": f.id, "path": [], "line": node.lineno, "col": node.col_offset})
            elif isinstance(f, ast.Attribute) and f.attr not in STOPLIST:
                receiver = [] if isinstance(f.value, _LITERAL) else [_text(f.value)]
                self.functions[-1]["calls"].append({"name": f.attr, "path": receiver, "line": node.lineno, "col": node.col_offset})
        for x in [*node.args, *(k.value for k in node.keywords)]:
            self.value(x)
        self.generic_visit(node)

    def value(self, node):
        """A name used as a value may be a function handed on."""
        if self.functions and isinstance(node, ast.Name) and node.id not in STOPLIST:
            self.functions[-1]["value_refs"].append({"name": node.id, "path": [], "line": node.lineno, "col": node.col_offset})

    def visit_Assign(self, node):
        self.value(node.value)
        if not self.functions and not self.classes:
            for t in node.targets:
                if isinstance(t, ast.Name) and t.id.isupper():
                    self.add("constant", t.id, node, value=_text(node.value))
        self.generic_visit(node)

    def visit_AnnAssign(self, node):
        if node.value is not None:
            self.value(node.value)
        if not self.functions and not self.classes and isinstance(node.target, ast.Name):
            if "TypeAlias" in _text(node.annotation):
                self.add("type_alias", node.target.id, node, value=_text(node.value))
            elif node.target.id.isupper():
                self.add("constant", node.target.id, node, value=_text(node.value))
        self.generic_visit(node)

    def visit_TypeAlias(self, node):
        self.add("type_alias", node.name.id, node, value=_text(node.value))

    def visit_Return(self, node):
        if node.value is not None:
            self.value(node.value)
        self.generic_visit(node)

    def visit_Dict(self, node):
        for x in node.values:
            self.value(x)
        self.generic_visit(node)

    def visit_List(self, node):
        for x in node.elts:
            self.value(x)
        self.generic_visit(node)

    def visit_If(self, node):
        typing = "TYPE_CHECKING" in _text(node.test)
        self.guarded += typing
        for x in node.body:
            self.visit(x)
        self.guarded -= typing
        self.visit(node.test)
        for x in node.orelse:
            self.visit(x)

    def visit_Import(self, node):
        for i, a in enumerate(node.names):
            row = self.add("import", a.name, node, raw=_text(node), import_kind="ModuleImport", module=a.name, level=0, names=[{"name": a.name, "alias": a.asname}])
            row["id"] = f"{self.path}::import@{node.lineno}" + (f".{i}" if i else "")

    def visit_ImportFrom(self, node):
        star = any(a.name == "*" for a in node.names)
        kind = "RelativeImport" if node.level else "StarImport" if star else "FromImport"
        row = self.add("import", node.module or "." * node.level, node, raw=_text(node), import_kind=kind, module=node.module, level=node.level, names=[{"name": a.name, "alias": a.asname} for a in node.names])
        row["id"] = f"{self.path}::import@{node.lineno}"


def units(path: str, text: str) -> list[dict]:
    """Rows of one file."""
    v = _Units(path, text)
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    head = {"kind": "module", "id": v.module, "name": stem, "qualified_name": stem, "path": path, "language": "Python", "line": 1, "exit_line": text.count("\n") + 1, "content_hash": digest(text), "source": text, "calls": []}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [head | {"error": str(e)}]
    head |= {"star_exports": exports(tree), "docstring": ast.get_docstring(tree)}
    for n in tree.body:
        v.visit(n)
    known = {r["name"] for r in v.rows if r["kind"] == "function"}
    for r in v.rows:
        if r["kind"] == "import":
            known |= {n["alias"] or n["name"] for n in r["names"]}
    for r in v.rows:
        if r["kind"] == "function":
            seen, kept = set(), []
            for c in r["value_refs"]:
                key = (c["name"], c["line"], c["col"])
                if c["name"] in known and key not in seen and c["name"] not in SELF_NAMES:
                    seen.add(key)
                    kept.append(c)
            r["value_refs"] = kept
    return [head, *v.rows]


def extract(files: DataFrame) -> DataFrame:
    """Units of (path, text).  Null texts give nothing; other columns are ignored."""
    ship(files.sparkSession)
    schema: StructType = _parse_datatype_string(UNIT)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = units(path, text)
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "text").where(F.col("path").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, schema)
