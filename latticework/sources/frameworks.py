"""Routes, components and associations that web frameworks declare, as nodes and edges.

Python frameworks are read with the standard library's parser, the others with
patterns; both run file by file in mapInArrow.  A declaration gives one row:
its node, and the edge to the handler where one is named.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.cluster import ship

ROW = "framework string, node_id string, name string, node_kind string, path string, line int, method string, route string, target string, edge_kind string"
_SCHEMA = pa.schema([(n, pa.int32() if t == "int" else pa.string()) for n, t in (c.split() for c in ROW.split(", "))])
VERBS = "get|post|put|patch|delete|options|head"
_Q = r"""["'`]([^"'`]*)["'`]"""


def _row(fw, path, line, route, target=None, method=None, kind="route", edge="handles", key=None):
    ident = key or f"{fw}:{kind}:{path}:{line}:{method or 'ANY'}:{route}"
    return {"framework": fw, "node_id": ident, "name": f"{method} {route}" if method else route, "node_kind": kind, "path": path, "line": line, "method": method, "route": route, "target": target or None, "edge_kind": edge if target else None}


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _join(*parts: str | None) -> str:
    return "/" + "/".join(x for p in parts if p and (x := p.strip("/")))


def _last_name(expr: str) -> str:
    names = re.findall(r"[A-Za-z_$][\w$]*", expr)
    return names[-1] if names else ""


def _dotted(node) -> str:
    return ast.unparse(node) if node is not None else ""


def _text(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _calls(tree):
    return (n for n in ast.walk(tree) if isinstance(n, ast.Call))


def _keyword(call: ast.Call, name: str):
    return next((k.value for k in call.keywords if k.arg == name), None)


def django(path, text, tree):
    for n in ast.walk(tree):
        target = n.targets[0] if isinstance(n, ast.Assign) else n.target if isinstance(n, (ast.AugAssign, ast.AnnAssign)) else None
        if isinstance(target, ast.Name) and target.id == "urlpatterns" and n.value is not None:
            for c in _calls(n.value):
                fn = _dotted(c.func)
                if fn.split(".")[-1] in ("path", "re_path", "url") and c.args and (route := _text(c.args[0])) is not None:
                    view = c.args[1] if len(c.args) > 1 else _keyword(c, "view")
                    if isinstance(view, ast.Call) and _dotted(view.func).endswith("include"):
                        yield _row("django", path, c.lineno, route, _text(view.args[0]) if view.args else None, edge="registers")
                    else:
                        yield _row("django", path, c.lineno, route, re.sub(r"\.as_view\(.*\)$", "", _dotted(view)))
    for c in _calls(tree):
        fn = _dotted(c.func)
        if fn.endswith("site.register") and c.args:
            yield _row("django", path, c.lineno, _dotted(c.args[0]), _dotted(c.args[1]) if len(c.args) > 1 else _dotted(c.args[0]), kind="admin", edge="registers")
        elif fn.endswith("router.register") and len(c.args) > 1 and (route := _text(c.args[0])) is not None:
            yield _row("django", path, c.lineno, route, _dotted(c.args[1]), kind="viewset", edge="registers")
    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef):
            for d in n.decorator_list:
                if isinstance(d, ast.Call) and _dotted(d.func).endswith("admin.register"):
                    yield from (_row("django", path, n.lineno, _dotted(a), n.name, kind="admin", edge="registers") for a in d.args)


def _decorated(tree, kinds):
    for n in ast.walk(tree):
        if isinstance(n, kinds):
            for d in n.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute):
                    yield n, d


def flask(path, text, tree):
    for n, d in _decorated(tree, (ast.FunctionDef, ast.AsyncFunctionDef)):
        name = d.func.attr
        if d.args and (route := _text(d.args[0])) is not None:
            if name == "route":
                methods = _keyword(d, "methods")
                verbs = [_text(x) for x in methods.elts] if isinstance(methods, (ast.List, ast.Tuple)) else ["GET"]
                yield from (_row("flask", path, n.lineno, route, n.name, v) for v in verbs if v)
            elif name in VERBS.split("|"):
                yield _row("flask", path, n.lineno, route, n.name, name.upper())
    for c in _calls(tree):
        fn = c.func.attr if isinstance(c.func, ast.Attribute) else ""
        if fn == "add_resource" and len(c.args) > 1:
            yield from (_row("flask", path, c.lineno, r, _dotted(c.args[0])) for a in c.args[1:] if (r := _text(a)) is not None)
        elif fn == "register_blueprint" and c.args:
            yield _row("flask", path, c.lineno, _text(_keyword(c, "url_prefix")) or "/", _dotted(c.args[0]), kind="blueprint", edge="registers")
        elif fn == "add_url_rule" and c.args and (r := _text(c.args[0])) is not None:
            view = _keyword(c, "view_func") or (c.args[2] if len(c.args) > 2 else None)
            yield _row("flask", path, c.lineno, r, _dotted(view))


def fastapi(path, text, tree):
    prefix = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and _dotted(n.value.func).endswith("APIRouter") and isinstance(n.targets[0], ast.Name):
            prefix[n.targets[0].id] = _text(_keyword(n.value, "prefix")) or ""
    for n, d in _decorated(tree, (ast.FunctionDef, ast.AsyncFunctionDef)):
        name = d.func.attr
        route = _text(d.args[0]) if d.args else _text(_keyword(d, "path"))
        if route is not None and name in [*VERBS.split("|"), "api_route", "websocket"]:
            full = prefix.get(_dotted(d.func.value), "") + route
            methods = _keyword(d, "methods")
            verbs = [_text(x) for x in methods.elts] if isinstance(methods, (ast.List, ast.Tuple)) else [None if name in ("api_route", "websocket") else name.upper()]
            yield from (_row("fastapi", path, n.lineno, full, n.name, v, key=f"fastapi:route:{path}:{v or 'ANY'}:{full}") for v in verbs)
            for default in [*n.args.defaults, *n.args.kw_defaults]:
                if isinstance(default, ast.Call) and _dotted(default.func).split(".")[-1] == "Depends" and default.args:
                    yield _row("fastapi", path, default.lineno, n.name, _dotted(default.args[0]), kind="dependency", edge="depends_on")
    for c in _calls(tree):
        if isinstance(c.func, ast.Attribute) and c.func.attr == "include_router" and c.args:
            yield _row("fastapi", path, c.lineno, _text(_keyword(c, "prefix")) or "/", _dotted(c.args[0]), kind="router", edge="registers")


def go(path, text):
    for m in re.finditer(r"\b\w+(?:\.\w+\([^()]*\))?\.(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Any|Get|Post|Put|Patch|Delete|Head|Options|Handle|HandleFunc)\(\s*" + _Q + r"\s*,\s*([^\n]+?)\)\s*(?:\n|$|\.)", text):
        verb, route = m[1], m[2]
        if verb in ("Handle", "HandleFunc"):
            head = re.match(r"(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(.*)", route)
            verb, route = (head[1], head[2]) if head else ("ANY", route)
        yield _row("go", path, _line(text, m.start()), route, _last_name(m[3].split(",")[-1]), verb.upper())


def actix(path, text):
    for m in re.finditer(r"#\[(" + VERBS + r')\(\s*"([^"]*)"[^\]]*\)\]\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)', text):
        yield _row("actix", path, _line(text, m.start()), m[2], m[3], m[1].upper())
    taken = set()
    for m in re.finditer(r'web::resource\(\s*"([^"]*)"\s*\)', text):
        stop = re.search(r"\.service\(|web::resource\(|web::scope\(|;", text[m.end() :])
        body = text[m.end() : m.end() + stop.start()] if stop else text[m.end() :]
        for h in re.finditer(r"web::(" + VERBS + r")\(\)\s*\.to\(\s*([\w:]+)", body):
            taken.add(m.end() + h.start())
            yield _row("actix", path, _line(text, m.end() + h.start()), m[1], _last_name(h[2]), h[1].upper())
        for h in re.finditer(r"^\s*\.to\(\s*([\w:]+)", body):
            yield _row("actix", path, _line(text, m.start()), m[1], _last_name(h[1]), "ANY")
    for m in re.finditer(r'\.route\(\s*"([^"]*)"\s*,\s*web::(' + VERBS + r")\(\)\s*\.to\(\s*([\w:]+)", text):
        yield _row("actix", path, _line(text, m.start()), m[1], _last_name(m[3]), m[2].upper())


def _arguments(text: str, at: int) -> list[str]:
    """Arguments of the call whose opening bracket is at ``at``, split at commas of the outermost level."""
    depth, start, out, quote = 0, at + 1, [], ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote and text[i - 1] != "\\" else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                out.append(text[start:i].strip())
                break
        elif c == "," and depth == 1:
            out.append(text[start:i].strip())
            start = i + 1
    return [x for x in out if x]


def _handler(args: list[str]) -> str | None:
    last = args[-1] if args else ""
    return last.split(".")[-1] if re.fullmatch(r"[A-Za-z_$][\w$.]*", last) else None


def express(path, text):
    for m in re.finditer(r"\b([A-Za-z_$][\w$]*)\.(" + VERBS + r"|all|use)\(", text):
        args = _arguments(text, m.end() - 1)
        route = re.fullmatch(_Q, args[0]) if args else None
        if m[2] == "use":
            if route and len(args) > 1:
                yield _row("express", path, _line(text, m.start()), route[1], _handler(args[1:]), None, kind="mount", edge="registers")
        elif route and len(args) > 1:
            yield _row("express", path, _line(text, m.start()), route[1], _handler(args[1:]), "ANY" if m[2] == "all" else m[2].upper())
    for m in re.finditer(r"\.route\(\s*" + _Q + r"\s*\)", text):
        at = m.end()
        while h := re.compile(r"\s*\.(" + VERBS + r"|all)\(").match(text, at):
            args = _arguments(text, h.end() - 1)
            yield _row("express", path, _line(text, h.start(1)), m[1], _handler(args), "ANY" if h[1] == "all" else h[1].upper())
            depth, at = 0, h.end() - 1
            for i in range(at, len(text)):
                depth += (text[i] in "([{") - (text[i] in ")]}")
                if not depth:
                    at = i + 1
                    break


def _class_before(text: str, at: int, pattern: str):
    found = None
    for m in re.finditer(pattern, text[:at]):
        found = m
    return found


def spring(path, text):
    classes = [(m.start(), m[1]) for m in re.finditer(r"\bclass\s+(\w+)", text)]
    for m in re.finditer(r"@(Get|Post|Put|Patch|Delete|Request)Mapping(?:\(([^)]*)\))?", text):
        if re.match(r"(?:\s*@\w+(?:\([^)]*\))?)*\s*(?:(?:public|abstract|final)\s+)*class\b", text[m.end() :]):
            continue
        body = m[2] or ""
        routes = re.findall(r'"([^"]*)"', re.sub(r"\b(?:produces|consumes|headers|params|name)\s*=\s*(?:\{[^}]*\}|\"[^\"]*\"|[\w.]+)", "", body)) or [""]
        verb = m[1].upper() if m[1] != "Request" else (re.search(r"RequestMethod\.(\w+)", body) or ["", "ANY"])[1]
        owner = [c for c in classes if c[0] < m.start()]
        prefix = ""
        if owner:
            head = text[(owner[-2][0] if len(owner) > 1 else 0) : owner[-1][0]]
            p = re.findall(r'@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*"([^"]*)"', head)
            prefix = p[-1] if p else ""
        fn = re.search(r"(\w+)\s*\(", re.sub(r"^(?:\s*@\w+(?:\([^)]*\))?)*", "", text[m.end() : m.end() + 600]))
        for r in routes:
            yield _row("spring", path, _line(text, m.start()), _join(prefix, r), (f"{owner[-1][1]}." if owner else "") + fn[1] if fn else None, verb)


_RESOURCE = (("GET", "", "index"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("PUT", "/{id}", "update"), ("DELETE", "/{id}", "destroy"))


def laravel(path, text):
    groups = []
    for m in re.finditer(r"prefix['\"]?\s*(?:=>|\()\s*['\"]([^'\"]*)['\"]", text):
        brace = text.find("{", m.end())
        depth, end = 0, len(text)
        for i in range(brace if brace >= 0 else len(text), len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if not depth:
                end = i
                break
        groups.append((m.start(), end, m[1]))

    def full(at, route):
        return _join(*[g for a, b, g in groups if a < at < b], route)

    for m in re.finditer(r"Route::(?:[\w]+\([^;{]*?\)->)?(" + VERBS + r"|any)\(", text):
        args = _arguments(text, m.end() - 1)
        if len(args) > 1 and (route := re.fullmatch(_Q, args[0])):
            h = re.search(r"(\w+)::class\s*,\s*['\"](\w+)", args[1]) or re.search(r"['\"](?:.*\\)?(\w+)@(\w+)", args[1])
            single = re.match(r"(\w+)::class", args[1])
            yield _row("laravel", path, _line(text, m.start()), full(m.start(), route[1]), f"{h[1]}.{h[2]}" if h else single[1] if single else None, "ANY" if m[1] == "any" else m[1].upper())
    for m in re.finditer(r"Route::(resource|apiResource)\(\s*" + _Q + r"\s*,\s*(?:['\"](?:.*\\)?)?(\w+)", text):
        for verb, tail, fn in _RESOURCE:
            yield _row("laravel", path, _line(text, m.start()), full(m.start(), m[2] + tail), f"{m[3]}.{fn}", verb)


def aspnet(path, text):
    for m in re.finditer(r"\[Http(Get|Post|Put|Patch|Delete|Head|Options)(?:\(\s*(?:\"([^\"]*)\")?[^)]*\))?\]", text):
        owner = _class_before(text, m.start(), r"\bclass\s+(\w+)")
        prefix = ""
        if owner:
            p = re.findall(r'\[Route\("([^"]*)"\)\]', text[: owner.start()])
            prefix = (p[-1] if p else "").replace("[controller]", re.sub("Controller$", "", owner[1]).lower())
        rest = re.sub(r"^(?:\s*\[[^\]]*\])*", "", text[m.end() : m.end() + 800])
        route = m[2] or (re.match(r"(?:\s*\[[^\]]*\])*?\s*\[Route\(\"([^\"]*)\"", text[m.end() : m.end() + 400]) or [None, ""])[1]
        fn = re.search(r"(\w+)\s*(?:<[^>(]*>)?\s*\(", rest)
        yield _row("aspnet", path, _line(text, m.start()), route[1:] if route.startswith("~") else _join(prefix, route), f"{owner[1]}.{fn[1]}" if owner and fn else None, m[1].upper())
    for m in re.finditer(r"\.Map(Get|Post|Put|Patch|Delete)\(", text):
        args = _arguments(text, m.end() - 1)
        if args and (route := re.fullmatch(_Q, args[0])):
            yield _row("aspnet", path, _line(text, m.start()), route[1], _handler(args[1:]), m[1].upper())


def rails(path, text):
    owner = re.search(r"class\s+([\w:]+)", text)
    if not owner:
        return
    for m in re.finditer(r"^\s*(has_many|has_one|belongs_to|has_and_belongs_to_many)\s+:(\w+)", text, re.M):
        named = re.search(r"class_name:\s*['\"]([\w:]+)", text[m.end() : text.find("\n", m.end()) if "\n" in text[m.end() :] else len(text)])
        plain = m[2].removesuffix("s") if "many" in m[1] else m[2]
        yield _row("rails", path, _line(text, m.start()), f"{owner[1]}.{m[1]}.{m[2]}", named[1] if named else "".join(p.capitalize() for p in plain.split("_")), kind="assoc", edge="references", key=f"rails:assoc:{path}:{owner[1]}:{m[1]}:{m[2]}")
    for m in re.finditer(r"^\s*((?:before|after|around)_\w+)\s+((?::\w+\s*,?\s*)+)", text, re.M):
        for name in re.findall(r":(\w+)(?!\w*:)", m[2]):
            yield _row("rails", path, _line(text, m.start(1)), f"{owner[1]}.{m[1]}", f"{owner[1]}.{name}", kind="callback", edge="calls", key=f"rails:callback:{path}:{owner[1]}:{m[1]}:{name}")
    for m in re.finditer(r"^\s*(" + VERBS + r")\s+['\"]([^'\"]+)['\"]\s*(?:,\s*to:|=>)\s*['\"](\w+)#(\w+)", text, re.M):
        yield _row("rails", path, _line(text, m.start()), m[2], f"{m[3]}.{m[4]}", m[1].upper())


def nestjs(path, text):
    for m in re.finditer(r"@(Get|Post|Put|Patch|Delete|Options|Head|All)\(\s*(?:" + _Q + r")?[^)]*\)", text):
        owner = _class_before(text, m.start(), r"@Controller\(\s*(?:\{[^}]*path:\s*)?(?:" + _Q + r")?[^)]*\)[^{]*?class\s+(\w+)")
        if not owner:
            continue
        fn = re.search(r"(?:async\s+)?(\w+)\s*\(", re.sub(r"^(?:\s*@\w+\([^)]*\))*", "", text[m.end() : m.end() + 400]))
        yield _row("nestjs", path, _line(text, m.start()), _join(owner[1], m[2]), f"{owner[2]}.{fn[1]}" if fn else None, "ANY" if m[1] == "All" else m[1].upper())
    for m in re.finditer(r"@Module\(\s*\{(.*?)\}\s*\)\s*(?:export\s+)?class\s+(\w+)", text, re.S):
        for kind in ("imports", "controllers", "providers", "exports"):
            listed = re.search(kind + r"\s*:\s*\[([^\]]*)\]", m[1])
            for name in re.findall(r"\b([A-Z]\w*)", listed[1] if listed else ""):
                yield _row("nestjs", path, _line(text, m.start()), m[2], name, kind="module", edge="registers", key=f"nestjs:module:{path}:{m[2]}:{kind}:{name}")


def vue(path, text):
    for m in re.finditer(r"\{[^{}]*?\bpath\s*:\s*" + _Q + r"((?:[^{}]|\{[^{}]*\})*?)(?=\bpath\s*:|\}\s*,?\s*[\]}{]|\}\s*\)|\}\s*,)", text):
        body = m[2]
        lazy = re.search(r"component\s*:\s*(?:async\s*)?\(\)\s*=>\s*import\(\s*['\"`](?:.*/)?([\w-]+)(?:\.vue)?", body)
        plain = re.search(r"component\s*:\s*([A-Za-z_$][\w$]*)", body)
        yield _row("vue", path, _line(text, m.start(1)), m[1], lazy[1] if lazy else plain[1] if plain else None)


def react(path, text):
    for m in re.finditer(r"<Route\b((?:[^<>]|<[^<>]*/>|=>)*?)/?>", text):
        route = re.search(r"\bpath\s*=\s*\{?" + _Q, m[1])
        view = re.search(r"\b(?:element|component)\s*=\s*\{\s*<?\s*([A-Z]\w*)", m[1])
        if route or view:
            yield _row("react", path, _line(text, m.start()), route[1] if route else "(index)", view[1] if view else None)
    for m in re.finditer(r"\{\s*path\s*:\s*" + _Q + r"([^{}]*(?:\{[^{}]*\})?[^{}]*)", text):
        view = re.search(r"\b(?:element\s*:\s*<\s*|Component\s*:\s*)([A-Z]\w*)", m[2])
        yield _row("react", path, _line(text, m.start()), m[1], view[1] if view else None)
    for m in re.finditer(r"<(?:Link|NavLink)\b[^>]*?\bto\s*=\s*\{?" + _Q, text):
        yield _row("react", path, _line(text, m.start()), m[1], m[1], kind="navigation", edge="navigates")


#: name -> (suffixes, words one of which a file has, reader, whether it takes a syntax tree)
FRAMEWORKS = {
    "django": ((".py",), ("django", "urlpatterns", "admin.site"), django, True), "flask": ((".py",), ("flask",), flask, True), "fastapi": ((".py",), ("fastapi",), fastapi, True),
    "go": ((".go",), ("(",), go, False), "actix": ((".rs",), ("actix",), actix, False), "express": ((".js", ".ts", ".mjs", ".cjs"), ("express", "router.", "Router("), express, False),
    "spring": ((".java", ".kt"), ("Mapping",), spring, False), "laravel": ((".php",), ("Route::",), laravel, False), "aspnet": ((".cs",), ("[Http", ".Map"), aspnet, False), "rails": ((".rb",), ("class ", "routes"), rails, False),
    "nestjs": ((".ts",), ("@Controller", "@Module"), nestjs, False), "vue": ((".js", ".ts", ".vue"), ("vue-router", "createRouter", "VueRouter"), vue, False), "react": ((".jsx", ".tsx", ".js", ".ts"), ("react-router",), react, False),
}


def routes_of(path: str, text: str) -> list[dict]:
    out = []
    for suffixes, signs, reader, tree in FRAMEWORKS.values():
        if path.endswith(suffixes) and any(s.lower() in text.lower() for s in signs):
            try:
                found = reader(path, text, ast.parse(text)) if tree else reader(path, text)
                out += list(found)
            except (SyntaxError, ValueError):
                pass
    seen: dict[tuple, dict] = {}
    for r in out:
        seen.setdefault((r["node_id"], r["target"]), r)
    return list(seen.values())


def routes(files: DataFrame) -> DataFrame:
    """Declarations in (path, text); null texts give none."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = [r for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in routes_of(p, t)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return files.select("path", "text").where(F.col("path").isNotNull() & F.col("text").isNotNull()).mapInArrow(run, ROW)


def route_edges(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges from routes to the entities that their handlers name: the same file first, then any of that name."""
    from latticework.operators.graph import first_by

    names = entities.select(F.col("id").alias("dst"), F.col("name").alias("short"), F.col("path").alias("at"), "qualified_name")
    want = found.where("target is not null").select("node_id", "path", "target", "edge_kind", "line", F.substring_index("target", ".", -1).alias("short"))
    near = F.when(F.col("path") == F.col("at"), 0).otherwise(1)
    full = F.when(F.endswith("qualified_name", F.col("target")), 0).otherwise(1)
    best = first_by(want.join(names, "short"), ["node_id", "target"], full, near, "dst")
    sure = F.when((near == 0) | (full == 0), 0.85).otherwise(0.65)
    return best.select(F.col("node_id").alias("src"), "dst", F.col("edge_kind").alias("kind"), F.lit("framework").alias("provenance"), sure.alias("confidence"), "line")
