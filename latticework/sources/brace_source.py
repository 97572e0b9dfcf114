"""Source files of brace languages (and Ruby, Lua, PHP, shell) -> the same unit rows as Python files.

A lexer blanks strings and comments without moving offsets; declarations are
found by per-language patterns, bodies by matching braces (or do/end words).
That is less than a grammar knows: types of expressions, macros and generated
code are not understood.  Metrics follow the rules of the Python extractor:
one branch for each decision word, case arm and ternary, and nesting by the
blocks that decisions open.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from latticework.cluster import ship
from latticework.schema import SELF_NAMES, STOPLIST, UNIT

from .python_source import digest

_ID = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Grammar:
    """Patterns with the groups name, bases, params, returns, module, names."""

    classes: tuple[str, ...] = ()
    functions: tuple[str, ...] = ()
    imports: tuple[str, ...] = ()
    line_comments: tuple[str, ...] = ("//",)
    block_comments: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: str = "\"'"
    words: bool = False  # blocks end with the word end


_NOT = r"(?!(?:if|for|while|switch|catch|return|else|do|new|function|await|typeof|match|loop|sizeof|using|lock|when|in|of)\b)"
_ECMA = Grammar(
    (rf"\b(?:class|interface)\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\s+extends\s+(?P<bases>[\w$., <>]+?))?(?:\s+implements\s+(?P<more>[\w$., <>]+?))?\s*(?=\{{)",),
    (
        rf"\bfunction\s*\*?\s*(?P<name>{_ID})\s*(?:<[^>(]*>)?\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s*:\s*(?P<returns>[^{{;]+?))?\s*(?=\{{)",
        rf"\b(?:const|let|var)\s+(?P<name>{_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\((?P<params>[^()]*)\)|{_ID})(?:\s*:\s*(?P<returns>[^=\n]+?))?\s*=>\s*(?=\{{)",
        rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set|\*)\s+)*{_NOT}(?P<name>#?{_ID})\s*(?:<[^>(]*>)?\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s*:\s*(?P<returns>[^{{;\n]+?))?\s*(?=\{{)",
    ),
    (r"""(?m)^\s*import\s+(?:type\s+)?(?P<names>[^'"\n;]*?)\s*(?:from\s*)?["'](?P<module>[^"']+)["']""", r"""\brequire\(\s*["'](?P<module>[^"']+)["']\s*\)"""),
    quotes="\"'`",
)
_JVM = Grammar(
    (rf"\b(?:class|interface|enum|record|object|trait)\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\([^)]*\))?(?:\s*(?:extends|:)\s+(?P<bases>[\w$., <>()]+?))?(?:\s+(?:implements|with)\s+(?P<more>[\w$., <>]+?))?\s*(?=\{{)",),
    (
        rf"(?m)^[ \t]*(?:@{_ID}(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|internal|static|final|abstract|synchronized|override|virtual|async|sealed|default|native)\s+)*(?:<[^>]*>\s*)?(?P<returns>[A-Za-z_][\w.<>\[\],? ]*?)\s+{_NOT}(?P<name>{_ID})\s*(?:<[^>(]*>)?\((?P<params>[^()]*)\)(?:\s*throws\s+[\w., ]+)?\s*(?=\{{)",
        rf"\b(?:fun|def)\s+(?:<[^>]*>\s*)?(?:{_ID}\.)?(?P<name>{_ID})\s*\((?P<params>[^()]*)\)(?:\s*:\s*(?P<returns>[\w.<>?\[\]]+))?\s*=?\s*(?=\{{)",
        rf"(?m)^[ \t]*(?:(?:public|private|protected|internal)\s+)+{_NOT}(?P<name>{_ID})\s*\((?P<params>[^()]*)\)(?:\s*:\s*(?:base|this)\([^)]*\))?\s*(?=\{{)",
    ),
    (r"(?m)^\s*(?:import|using)\s+(?:static\s+)?(?P<module>[\w.]+(?:\.\*)?)\s*;?\s*$",),
)
_GO = Grammar(
    (rf"\btype\s+(?P<name>{_ID})(?:\[[^\]]*\])?\s+(?:struct|interface)\s*(?=\{{)",),
    (rf"\bfunc\s+(?:\(\s*(?:{_ID}\s+)?\*?(?P<owner>{_ID})(?:\[[^\]]*\])?\s*\)\s*)?(?P<name>{_ID})\s*(?:\[[^\]]*\])?\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?P<returns>[^{{\n]*?)\s*(?=\{{)",),
    (r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"(?P<module>[\w./-]+)"\s*$',),
    quotes="\"'`",
)
_RUST = Grammar(
    (rf"\b(?:struct|enum|trait)\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\s*:\s*(?P<bases>[\w:+ <>]+?))?\s*(?:where[^{{]*)?(?=\{{)", rf"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<container>{_ID})(?:<[^{{]*>)?\s*(?:where[^{{]*)?(?=\{{)"),
    (rf"\bfn\s+(?P<name>{_ID})\s*(?:<[^(]*>)?\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)(?:\s*->\s*(?P<returns>[^{{;]+?))?\s*(?:where[^{{]*)?(?=\{{)",),
    (r"(?m)^\s*(?:pub\s+)?use\s+(?P<module>[\w:]+)(?:::\{(?P<names>[^}]*)\})?",),
    quotes='"',
)
_C = Grammar(
    (rf"\b(?:class|struct)\s+(?P<name>{_ID})(?:\s+final)?(?:\s*:\s*(?P<bases>[\w:, <>]+?))?\s*(?=\{{)",),
    (rf"(?m)^[ \t]*(?P<returns>[A-Za-z_][\w:<>,*& ]*?[ *&])\s*{_NOT}(?:(?P<owner>{_ID})::)?(?P<name>~?{_ID})\s*\((?P<params>[^()]*)\)(?:\s*(?:const|noexcept|override))*\s*(?=\{{)",),
    (r'(?m)^\s*#\s*include\s*["<](?P<module>[^">]+)[">]',),
)
_PHP = Grammar(
    (rf"\b(?:class|interface|trait)\s+(?P<name>{_ID})(?:\s+extends\s+(?P<bases>[\w\\, ]+?))?(?:\s+implements\s+(?P<more>[\w\\, ]+?))?\s*(?=\{{)",), (rf"\bfunction\s+&?(?P<name>{_ID})\s*\((?P<params>[^()]*)\)(?:\s*:\s*(?P<returns>[\w?\\|]+))?\s*(?=\{{)",),
    (r"(?m)^\s*use\s+(?P<module>[\w\\]+)\s*;",), line_comments=("//", "#"),
)
_SWIFT = Grammar((rf"\b(?:class|struct|enum|protocol|extension|actor)\s+(?P<name>{_ID})(?:<[^>{{]*>)?(?:\s*:\s*(?P<bases>[\w., <>]+?))?\s*(?=\{{)",), (rf"\bfunc\s+(?P<name>{_ID})\s*(?:<[^>(]*>)?\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)[^{{\n]*?(?:->\s*(?P<returns>[^{{\n]+?))?\s*(?=\{{)",), (r"(?m)^\s*import\s+(?P<module>[\w.]+)",))
_RUBY = Grammar((rf"(?m)^[ \t]*(?:class|module)\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<bases>[\w:]+))?",), (r"(?m)^[ \t]*def\s+(?:self\.)?(?P<name>\w+[?!=]?)(?:\s*\((?P<params>[^()]*)\))?",), (r"""(?m)^\s*require(?:_relative)?\s*\(?["'](?P<module>[^"']+)["']""",), ("#",), (("=begin", "=end"),), words=True)
_LUA = Grammar((), (rf"\bfunction\s+(?:(?P<owner>{_ID})[.:])?(?P<name>{_ID})\s*\((?P<params>[^()]*)\)",), (r"""\brequire\s*\(?\s*["'](?P<module>[^"']+)["']""",), ("--",), (("--[[", "]]"),), words=True)
_SHELL = Grammar((), (rf"(?m)^[ \t]*(?:function\s+)?(?P<name>{_ID})\s*\(\s*\)\s*(?=\{{)",), (r"(?m)^\s*(?:source|\.)\s+(?P<module>\S+)",), ("#",), ())
GRAMMARS = {
    "JavaScript": _ECMA, "TypeScript": _ECMA, "Vue": _ECMA, "Java": _JVM, "Kotlin": _JVM, "Scala": _JVM, "CSharp": _JVM, "Go": _GO, "Rust": _RUST, "C": _C, "Cpp": _C, "Php": _PHP, "Swift": _SWIFT, "Dart": _JVM, "Ruby": _RUBY, "Lua": _LUA, "Bash": _SHELL,
}
_DECISION = re.compile(r"\b(?:if|elsif|elif|elseif|for|foreach|while|until|case|when|catch|rescue|loop|unless)\b|(?<![?.])\?(?![?.:\])>,;=])")
_CALL = re.compile(rf"(?:(?P<head>[A-Za-z_$@][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*)\s*(?:\.|::|->|\?\.)\s*)?(?P<name>{_ID})[!?]?\s*(?:<[\w, ]*>)?\(")
_KEYWORDS = frozenset("if for while switch catch return else do new function await typeof match loop sizeof using lock when fn func def class struct impl until unless elsif super in and or not foreach require assert case throw yield".split())
_OPENERS = re.compile(r"\b(?:class|module|def|do|begin|case|function|then|repeat)\b|(?m:^[ \t]*(?:if|unless|while|until|for)\b)|\bend\b|\buntil\b")


def blanked(text: str, g: Grammar) -> str:
    """The text with comments and the insides of strings replaced by spaces; newlines and offsets stay."""
    out, i, n = list(text), 0, len(text)

    def blank(a, b):
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        for a, b in g.block_comments:
            if text.startswith(a, i):
                j = text.find(b, i + len(a))
                j = n if j < 0 else j + len(b)
                blank(i, j)
                i = j
                break
        else:
            if any(text.startswith(c, i) for c in g.line_comments):
                j = text.find("\n", i)
                j = n if j < 0 else j
                blank(i, j)
                i = j
            elif text[i] in g.quotes:
                q, j = text[i], i + 1
                while j < n and text[j] != q and (q == "`" or text[j] != "\n"):
                    j += 2 if text[j] == "\\" else 1
                blank(i + 1, j)
                i = j + 1
            else:
                i += 1
    return "".join(out)


def _brace_end(code: str, at: int) -> int:
    depth = 0
    for i in range(at, len(code)):
        if code[i] == "{":
            depth += 1
        elif code[i] == "}":
            depth -= 1
            if not depth:
                return i + 1
    return len(code)


def _word_end(code: str, at: int) -> int:
    depth = 1
    for m in _OPENERS.finditer(code, at):
        word = m.group().strip()
        if word == "end":
            depth -= 1
            if not depth:
                return m.end()
        elif word not in ("then", "until") and not (word in ("do",) and re.search(r"^[ \t]*(?:while|until|for)\b[^\n]*$", code[code.rfind("\n", 0, m.start()) + 1 : m.start()])):
            depth += 1
    return len(code)


def _nesting(code: str) -> int:
    """Deepest block that a decision opens; other braces don't count."""
    deepest, stack, opener = 0, [], ""
    for m in re.finditer(r"\b(if|else|for|foreach|while|switch|match|try|catch|finally|do|loop|case)\b|[{};]", code):
        word = m.group()
        if word == "{":
            stack.append(bool(opener))
            opener = ""
            deepest = max(deepest, sum(stack))
        elif word == "}":
            if stack:
                stack.pop()
            opener = ""
        elif word != ";":
            opener = "" if word in ("switch", "match") else word
    return deepest


def units(path: str, text: str, language: str) -> list[dict]:
    g = GRAMMARS[language]
    code = blanked(text, g)
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    at_line = lambda i: text.count("\n", 0, i) + 1
    bytes_ = (lambda i: i) if text.isascii() else (lambda i: len(text[:i].encode("utf-8", "surrogatepass")))
    module = f"{path}::module"
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    rows = [{"kind": "module", "id": module, "name": stem, "qualified_name": stem, "path": path, "language": language, "line": 1, "exit_line": len(starts) - 1, "content_hash": digest(text), "source": text, "calls": []}]
    found = []
    for kind, patterns in (("class", g.classes), ("function", g.functions)):
        for p in patterns:
            for m in re.finditer(p, code):
                if code[: m.start()].endswith(("new ", "else ")):
                    continue
                end = _word_end(code, m.end()) if g.words else _brace_end(code, m.end())
                found.append((m.start() + len(m.group()) - len(m.group().lstrip()), -end, kind, m))
    found.sort(key=lambda f: f[:2])
    frames: list[tuple[int, str, str, str]] = []  # end, kind, qualified name, id
    seen: set[int] = set()
    functions = []
    for start, end, kind, m in found:
        end, d = -end, m.groupdict()
        spot = m.start("container") if d.get("container") else m.start("name")
        if spot in seen:
            continue
        seen.add(spot)
        frames = [f for f in frames if f[0] > start]
        if d.get("container"):  # methods of an existing type
            frames.append((end, "class", d["container"], f"{path}::{d['container']}"))
            continue
        owner = d.get("owner")
        outer = [f for f in frames if f[1] == "class"]
        qual = f"{owner}.{d['name']}" if owner else ".".join([*([frames[-1][2]] if frames else []), d["name"]])
        ident = f"{path}::{qual}"
        source = text[start:end]
        row = {
            "kind": kind, "id": ident, "name": d["name"], "qualified_name": qual, "path": path, "language": language, "parent_module": module, "line": at_line(start), "exit_line": at_line(max(start, end - 1)), "source": source, "content_hash": digest(source),
            "parent_class": f"{path}::{owner}" if owner else outer[-1][3] if outer else None, "parent_function": next((f[3] for f in reversed(frames) if f[1] == "function"), None), "span": {"start": bytes_(start), "end": bytes_(end)},
            "name_span": {"start": bytes_(m.start("name")), "end": bytes_(m.end("name"))}, "body_span": {"start": bytes_(m.end()), "end": bytes_(end)}, "decorators": re.findall(r"@(\w+(?:\([^)]*\))?)", m.group()), "is_type_only": False, "docstring": _doc(text, start),
        }
        if kind == "class":
            bases = ",".join(x for x in (d.get("bases"), d.get("more")) if x)
            row |= {"bases": [b for x in re.split(r"[,+]", re.sub(r"<[^>]*>|\([^)]*\)|\b(?:public|private|protected|virtual)\b", "", bases)) if (b := x.strip().replace("\\", ".").replace("::", "."))], "fields": [], "grammar_kind": m.group().split()[0] if m.group().split()[0] in ("class", "interface", "struct", "enum", "trait") else "class", "is_dataclass": False}
        else:
            body = code[m.end() : end]
            row |= {
                "parameters": [p for x in _split(d.get("params") or "") if (p := _parameter(x, language == "Go"))], "return_type": (d.get("returns") or "").strip() or None, "function_kind": "Method" if row["parent_class"] else "Free", "is_async": bool(re.search(r"\basync\b", code[max(0, start - 12) : m.start("name")])),
                "is_generator": bool(re.search(r"\byield\b", body)), "cyclomatic": 1 + sum(1 for _ in _DECISION.finditer(body)) + (body.count("=>") if language == "Rust" else 0), "nesting_depth": _nesting(body), "return_count": len(re.findall(r"\breturn\b", body)), "signature_hash": digest(m.group()), "body_hash": digest(re.sub(r"\s+", " ", text[m.end() : end])), "calls": [], "value_refs": [],
            }
            functions.append((m.end(), end, row))
        rows.append(row)
        frames.append((end, kind, qual, ident))
    for m in _CALL.finditer(code):
        inner = [f for f in functions if f[0] <= m.start() < f[1]]
        name = m["name"]
        if inner and name not in _KEYWORDS and name not in STOPLIST:
            head = m["head"]
            if head and head.split(".")[0] in _KEYWORDS:
                head = None
            line = at_line(m.start("name"))
            inner[-1][2]["calls"].append({"name": name, "path": [head.lstrip("@") if head not in SELF_NAMES else head] if head else [], "line": line, "col": m.start() - starts[line - 1]})
    for p in g.imports:
        for m in re.finditer(p, text):
            d = m.groupdict()
            raw = m.group().strip()
            names = [{"name": x.split(" as ")[0].strip(), "alias": (x.split(" as ")[1].strip() if " as " in x else None)} for x in re.split(r"[,{}]", d.get("names") or "") if x.strip() and x.strip() != "*"]
            name = d["module"].replace("::", ".").replace("\\", ".")
            level = 1 if name.startswith("./") else 2 if name.startswith("../") else 0
            plain = re.sub(r"^(\.{1,2}/)+", "", name).rstrip(".*").replace("/", ".") if not name.startswith(("@/", "~/")) else name
            line = at_line(m.start() + len(m.group()) - len(m.group().lstrip()))
            rows.append({"kind": "import", "id": f"{path}::import@{line}", "name": name, "qualified_name": name, "path": path, "language": language, "parent_module": module, "line": line, "exit_line": line, "raw": raw, "module": plain, "level": level, "names": names, "import_kind": "RelativeImport" if level else "StarImport" if name.endswith("*") else "FromImport" if names else "ModuleImport", "is_type_only": bool(re.match(r"import\s+type\b", raw)), "content_hash": digest(raw), "source": raw})
    return rows


def _split(params: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in params:
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [x.strip() for x in [*out, part] if x.strip()]


def _parameter(text: str, name_first: bool = False) -> dict | None:
    left, _, default = text.partition("=")
    left = re.sub(r"@\w+(?:\([^)]*\))?\s*", "", left).strip()
    if left in ("self", "&self", "&mut self", "mut self", "void", "this"):
        return None
    many = left.startswith(("...", "*", "&*")) or "..." in left
    if ":" in left and "::" not in left:
        name, kind = (x.strip() for x in left.split(":", 1))
        name = name.split()[-1] if name else name
    else:
        words = left.replace("...", " ").split()
        words = words[1:] + words[:1] if name_first else [w for w in words if w not in ("private", "public", "protected", "readonly")]
        name, kind = (words[-1], " ".join(words[:-1]) or None) if words else (left, None)
    return {"name": name.lstrip("*&$.").rstrip("?"), "annotation": kind or None, "default_value": default.strip() or None, "is_varargs": many, "is_kwargs": False}


def _doc(text: str, start: int) -> str | None:
    """The run of comments just above a declaration, without their markers."""
    end = start
    while end and text[end - 1].isspace():
        end -= 1
    gap = text.count("\n", end, start)
    if text.endswith("*/", 0, end) and gap <= 1:
        begin = text.find("/*", text.rfind("*/", 0, end - 2) + 1, end - 2)
        while begin > 0 and text[text.rfind("\n", 0, begin) + 1 : begin].strip():  # within a line of code, or of the comment
            begin = text.find("/*", begin + 2, end - 2)
        begin = text.rfind("/*", 0, end - 2) if begin < 0 else begin
    else:
        begin = end
        while gap <= 2 and begin > 0 and re.match(r"[ \t]*(?://|#|--)", text[(line := text.rfind("\n", 0, begin) + 1) : begin]):
            begin = line - 1
        begin = -1 if begin == end else begin + 1
    if begin < 0:
        return None
    lines = [re.sub(r"^\s*(?:/\*+!?|\*+/|\*|//[/!]?|#+!?|--+)\s?|\s*\*+/\s*$", "", x) for x in text[begin:end].strip().split("\n")]
    return "\n".join(lines).strip() or None


def extract(files: DataFrame) -> DataFrame:
    """Units of (path, text, language); files of other languages give nothing."""
    ship(files.sparkSession)
    schema = _parse_datatype_string(UNIT)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for path, text, language in zip(*(b.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_pylist(units(path, text, language), schema=arrow)

    own = files.select("path", "text", "language").where(F.col("language").isin(*GRAMMARS) & F.col("path").isNotNull() & F.col("text").isNotNull())
    return own.mapInArrow(run, schema)
