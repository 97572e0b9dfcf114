"""Scalar functions on text, paths, ids and vectors, as Column expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTTP_VERBS = ("DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT")
#: Prefixes of a search that name a field, not a module.
FIELD_PREFIXES = ("kind", "lang", "language", "name", "path")


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normal_path(path) -> Column:
    """Forward slashes, without a leading ./"""
    return F.regexp_replace(F.translate(_col(path), "\\", "/"), r"^(\./)+", "")


def stem(path) -> Column:
    return F.regexp_replace(F.regexp_extract(normal_path(path), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def id_path(entity_id) -> Column:
    """What stands before the last :: of an id, its file."""
    return F.regexp_extract(_col(entity_id), r"^(.*)::[^:]*$", 1)


def id_name(entity_id) -> Column:
    return F.regexp_extract(_col(entity_id), r"([^:.]*)$", 1)


def cosine(a, b) -> Column:
    """0 for vectors of different lengths, or of length or norm 0."""
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(0.0)


def token_estimate(text) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4)).cast("int")


def content_digest(text) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def query_spelling(text) -> Column:
    """fn/3 becomes fn; mod:fn becomes mod.fn unless mod names a field."""
    bare = F.regexp_replace(F.trim(_col(text)), r"([A-Za-z_]\w*)/\d+\b", "$1")
    return F.regexp_replace(bare, r"\b(?!(?:" + "|".join(FIELD_PREFIXES) + r"):)([A-Za-z_]\w*):(?=[A-Za-z_])", "$1.")


def words(text) -> Column:
    """Names in a list: split at commas, semicolons and space, longer than one character."""
    return F.filter(F.split(_col(text), r"[,;\s]+"), lambda x: F.length(x) > 1)


def skeleton(body) -> Column:
    """Lines of a body that declare or return something, or call."""
    keep = lambda x: F.regexp(F.trim(x), F.lit(r"^(async |class |def |except|for |if |raise |return|try|while |with |yield|@)|\(.*\)"))
    return F.array_join(F.filter(F.split(_col(body), "\n"), keep), "\n")


def clean_comment(text) -> Column:
    """Comment markers of the usual languages stripped from each line, blank edges dropped."""
    out = _col(text)
    for pattern in (r"(?m)^[ \t]*/\*+[!*]?[ \t]?", r"(?m)[ \t]*\*+/[ \t]*$", r"(?m)^[ \t]*\*[ \t]?", r"(?m)^[ \t]*//[/!]?[ \t]?", r"(?m)^[ \t]*#+![ \t]?", r"(?m)^[ \t]*#+[ \t]?", r"(?m)^[ \t]*--+[ \t]?", r"(?m)^[ \t]*;+[ \t]?", r"(?m)^[ \t]*%+[ \t]?", r"(?m)^[ \t]*<!--[ \t]?", r"(?m)[ \t]*-->[ \t]*$", r"(?m)^[ \t]*\(\*+[ \t]?", r"(?m)[ \t]*\*+\)[ \t]*$"):
        out = F.regexp_replace(out, pattern, "")
    return F.trim(F.regexp_replace(out, r"(?m)[ \t]+$", ""))


def unquoted(text) -> Column:
    return F.regexp_replace(_col(text), r"""^(["'`])(.*)\1$""", "$2")


def leading_dots(module) -> Column:
    return F.length(F.regexp_extract(_col(module), r"^(\.*)", 1))


def joined_route(prefix, path) -> Column:
    """/prefix/path with single slashes and none at the end."""
    both = F.concat_ws("/", F.lit(""), F.coalesce(_col(prefix), F.lit("")), F.coalesce(_col(path), F.lit("")))
    return F.when(F.regexp(both, F.lit("^/+$")), F.lit("/")).otherwise(F.regexp_replace(F.regexp_replace(both, "/{2,}", "/"), "/$", ""))


def controller_route(template, class_name) -> Column:
    """[controller] in a route stands for the class's name without Controller, lower case."""
    return F.replace(_col(template), F.lit("[controller]"), F.lower(F.regexp_replace(_col(class_name), "Controller$", "")))


def iso_timestamp(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def flag(bits, at: int) -> Column:
    """A nullable boolean from a pair of bits: the lower says whether there is a value, the upper which."""
    b = _col(bits)
    return F.when(F.shiftright(b, at).bitwiseAND(1) == 1, F.shiftright(b, at + 1).bitwiseAND(1) == 1)


def clamped(x, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), _col(x)))


def path_score(edges, steps, alternatives) -> Column:
    """Confidence of a name path: 0.98 less 0.01 an edge and a step and 0.04 an alternative, from 0.90 to 1."""
    return clamped(0.98 - 0.01 * _col(edges) - 0.01 * _col(steps) - 0.04 * _col(alternatives), 0.90, 1.0)


def dot_id(text) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(_col(text), "[^A-Za-z0-9_]", "_"))


def short_label(text, most: int = 30) -> Column:
    t = _col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def line_diff(old, new) -> Column:
    """Lines that differ, place by place: (line, old, new), null where one text is shorter."""
    pair = F.zip_with(F.split(_col(old), "\n"), F.split(_col(new), "\n"), lambda a, b: F.struct(a.alias("old"), b.alias("new")))
    numbered = F.transform(pair, lambda p, i: F.struct((i + 1).alias("line"), p["old"].alias("old"), p["new"].alias("new")))
    return F.filter(numbered, lambda p: ~p["old"].eqNullSafe(p["new"]))


def indent_style(text) -> Column:
    """'tab' when more lines begin with tabs than with spaces, else the most common step of spaces ('4' without any)."""
    lines = F.split(_col(text), "\n")
    tabs = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("\t"))))
    widths = F.filter(F.transform(lines, lambda x: F.length(F.regexp_extract(x, "^( *)[^ ]", 1))), lambda n: n > 0)
    least = F.array_min(widths)
    count = F.transform(F.array_sort(F.array_distinct(widths)), lambda w: F.struct(F.size(F.filter(widths, lambda x: x == w)).alias("n"), (-w).alias("w")))
    most = F.array_max(count)["w"]
    return F.when(tabs > F.size(widths), "tab").when(least.isNull(), "4").otherwise((-most).cast("string"))
