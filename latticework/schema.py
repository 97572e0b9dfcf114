"""Row types of the catalogue, and the closed lists that its operators share."""

from __future__ import annotations

import builtins

PARAMETER = "struct<name:string,annotation:string,default_value:string,is_varargs:boolean,is_kwargs:boolean>"
CALL = "struct<name:string,path:array<string>,line:int,col:int>"
FIELD = "struct<name:string,type_annotation:string,default_value:string,is_class_var:boolean,line:int>"
NAME = "struct<name:string,alias:string>"
SPAN = "struct<start:int,end:int>"
#: One row a unit of source; kind says which of the columns are set.
UNIT = (
    "kind string, id string, name string, qualified_name string, path string, language string, parent_module string, parent_class string, parent_function string, line int, exit_line int, "
    f"docstring string, content_hash string, span {SPAN}, name_span {SPAN}, body_span {SPAN}, source string, decorators array<string>, "
    f"parameters array<{PARAMETER}>, return_type string, calls array<{CALL}>, value_refs array<{CALL}>, function_kind string, is_async boolean, is_generator boolean, cyclomatic int, nesting_depth int, return_count int, "
    f"signature_hash string, body_hash string, grammar_kind string, bases array<string>, fields array<{FIELD}>, is_dataclass boolean, "
    f"raw string, import_kind string, module string, level int, names array<{NAME}>, is_type_only boolean, star_exports array<string>, value string, error string"
)
EDGE = "src string, dst string, kind string, provenance string, confidence double, line int"
EDGE_KINDS = ("calls", "extends", "imports", "overrides")
#: Kinds that frameworks add; a walk over calls follows them too.
CALL_LIKE = ("calls", "depends_on", "handles", "navigates", "registers")
SEVERITIES = ("Info", "Medium", "High", "Critical")
OPEN_END = "9999-12-31 23:59:59"

#: Receivers and constants that are never call targets.
STOPLIST = frozenset(("None", "NULL", "false", "new", "nil", "null", "nullptr", "self", "super", "this", "true", "undefined"))
SELF_NAMES = frozenset(("cls", "self", "this"))
PYTHON_BUILTINS = frozenset(n for n in dir(builtins) if not n.startswith("_"))
#: Annotations that name no entity.
BUILTIN_TYPES = frozenset(("Any", "Dict", "List", "None", "Optional", "Set", "Tuple", "Union", "bool", "bytes", "dict", "float", "frozenset", "int", "list", "object", "set", "str", "tuple", "type"))

#: extension -> (language, tier, family); languages of one family may name each other's classes.
LANGUAGES = {
    "py": ("Python", 1, "python"), "pyi": ("Python", 1, "python"), "js": ("JavaScript", 1, "ecma"), "jsx": ("JavaScript", 1, "ecma"), "mjs": ("JavaScript", 1, "ecma"), "cjs": ("JavaScript", 1, "ecma"),
    "ts": ("TypeScript", 1, "ecma"), "tsx": ("TypeScript", 1, "ecma"), "rs": ("Rust", 1, "rust"), "go": ("Go", 1, "go"), "java": ("Java", 1, "jvm"), "kt": ("Kotlin", 2, "jvm"), "scala": ("Scala", 2, "jvm"),
    "c": ("C", 2, "c"), "h": ("C", 2, "c"), "cpp": ("Cpp", 2, "c"), "cc": ("Cpp", 2, "c"), "hpp": ("Cpp", 2, "c"), "cs": ("CSharp", 2, "dotnet"), "fs": ("FSharp", 3, "dotnet"), "rb": ("Ruby", 2, "ruby"),
    "php": ("Php", 2, "php"), "swift": ("Swift", 2, "swift"), "lua": ("Lua", 3, "lua"), "r": ("R", 3, "r"), "jl": ("Julia", 3, "julia"), "ex": ("Elixir", 3, "elixir"), "exs": ("Elixir", 3, "elixir"), "zig": ("Zig", 3, "zig"),
    "sh": ("Bash", 3, "shell"), "bash": ("Bash", 3, "shell"), "zsh": ("Bash", 3, "shell"), "sql": ("Sql", 3, "sql"), "html": ("Html", 3, "markup"), "css": ("Css", 3, "markup"), "vue": ("Vue", 2, "ecma"),
    "dart": ("Dart", 2, "dart"), "hs": ("Haskell", 3, "haskell"), "ml": ("OCaml", 3, "ocaml"), "nix": ("Nix", 3, "nix"), "cmake": ("CMake", 3, "build"), "toml": ("Toml", 3, "data"), "yaml": ("Yaml", 3, "data"), "json": ("Json", 3, "data"),
}
FILENAMES = {"CMakeLists.txt": "cmake", "Rakefile": "rb", "Gemfile": "rb", "BUILD.bazel": "py"}
IGNORED_PARTS = ("/.git/", "/__pycache__/", "/node_modules/", "/target/", "/.venv/", "/dist/", "/build/")
