"""From names to edges: imports, bases, overrides and calls, as cascades of joins.

Every tier of a cascade is an equi-join; where several tiers or candidates
match, the first in an explicit order wins, so results don't depend on how
rows happen to be spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.cluster import stored
from latticework.schema import LANGUAGES, PYTHON_BUILTINS, SELF_NAMES, STOPLIST

from . import mro as mro_operator
from .graph import first_by

#: Signature matching: most candidates of a name, weights, least score, band of confidence.
CEILING, W_NAME, W_ARITY, W_NEAR, LEAST = 500, 0.4, 0.3, 0.3, 0.5


def path_keys(path: Column) -> Column:
    """Every tail of a file's path without its extension; packages also by their folder."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.[A-Za-z0-9]+$", "")
    package = F.regexp_replace(bare, "/__init__$", "")

    def tails(p):
        parts = F.split(p, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    return F.array_distinct(F.concat(tails(bare), tails(package)))


def dotted_keys(name: Column) -> Column:
    """Every tail of a dotted module name, with / for dots; @/ and ~/ lead to src/."""
    plain = F.regexp_replace(F.regexp_replace(name, "^[@~]/", "src/"), r"\.", "/")
    parts = F.split(plain, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def longest_suffix(wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """(key, module_id): for each (key, dotted) the module whose path ends in the longest tail of the name.

    Tails begin at a folder's border.  Of several modules the one of the shortest path wins, then the first by path.
    """
    tails = wanted.where("dotted is not null and dotted <> ''").select("key", F.posexplode(dotted_keys(F.col("dotted"))).alias("cut", "tail"))
    known = modules.select(F.col("id").alias("module_id"), "path", F.explode(path_keys(F.col("path"))).alias("tail"))
    # which module a tail means doesn't depend on who asks: one row a tail, however many modules share it
    known = known.groupBy("tail").agg(F.min_by("module_id", F.struct(F.length("path"), "path", "module_id")).alias("module_id"))
    return tails.join(known, "tail").groupBy("key").agg(F.min_by("module_id", "cut").alias("module_id"))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """imports with resolved_module and target_kind (module, external or unresolved).  Relative names start at the importer's folder."""
    folder = F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), "^[^/]*$", "")
    up = F.split(folder, "/")
    base = F.array_join(F.slice(up, F.lit(1), F.greatest(F.lit(0), F.size(up) - F.greatest(F.col("level") - 1, F.lit(0)))), ".")
    dotted = F.when(F.col("level") > 0, F.concat_ws(".", F.when(base != "", base), F.coalesce("module", F.lit("__init__")))).otherwise(F.col("module"))
    found = longest_suffix(imports.select(F.col("id").alias("key"), dotted.alias("dotted")), modules)
    out = imports.join(found, imports["id"] == found["key"], "left").drop("key").withColumnRenamed("module_id", "resolved_module")
    return out.withColumn("target_kind", F.when(F.col("resolved_module").isNotNull(), "module").when(F.col("level") > 0, "unresolved").otherwise("external"))


def imported_names(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, name, target): the names that imports bring into a module, and the modules they lead to.

    A plain import counts under its last part, a star import under each exported
    name.  A name imported twice goes by the later line.
    """
    own = imports.where("resolved_module is not null")
    named = own.where(F.col("import_kind").isin("FromImport", "RelativeImport")).select("parent_module", "line", F.explode("names").alias("n"), "resolved_module")
    named = named.select("parent_module", "line", F.coalesce("n.alias", "n.name").alias("name"), F.col("n.name").alias("symbol"), "resolved_module")
    plain = own.where("import_kind = 'ModuleImport'").select("parent_module", "line", F.substring_index("module", ".", -1).alias("name"), F.lit(None).cast("string").alias("symbol"), "resolved_module")
    stars = own.where(F.exists("names", lambda n: n["name"] == "*")).select("parent_module", "line", "resolved_module").join(modules.select(F.col("id").alias("resolved_module"), "star_exports"), "resolved_module")
    stars = stars.select("parent_module", "line", F.explode("star_exports").alias("name"), "resolved_module").withColumn("symbol", F.col("name"))
    every = reduce(lambda a, b: a.unionByName(b), [named.where("symbol <> '*'"), plain, stars])
    return first_by(every, ["parent_module", "name"], F.desc("line"), "resolved_module").select(F.col("parent_module").alias("module"), "name", "symbol", F.col("resolved_module").alias("target"))


def symbols(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(module, name, id, is_class): the first function of a name in a module, else its first class."""
    f = functions.select(F.col("parent_module").alias("module"), "name", "id", "line", F.lit(False).alias("is_class"))
    c = classes.select(F.col("parent_module").alias("module"), "name", "id", "line", F.lit(True).alias("is_class"))
    return first_by(f.unionByName(c), ["module", "name"], "is_class", "line", "id").drop("line")


def _family(language: Column) -> Column:
    table = {v[0]: v[2] for v in LANGUAGES.values()}
    return F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])[language]


def base_candidates(classes: DataFrame, names: DataFrame) -> DataFrame:
    """(class_id, pos, base, candidates): classes that a base may mean, of the first tier that has any.

    Tiers: the same module, what the module imports, any class of a language of the same family.
    """
    wanted = classes.select(F.col("id").alias("class_id"), "parent_module", _family(F.col("language")).alias("family"), F.posexplode("bases").alias("pos", "base")).withColumn("short", F.substring_index("base", ".", -1))
    known = classes.select(F.col("id").alias("target"), F.col("name").alias("short"), F.col("parent_module").alias("in_module"), _family(F.col("language")).alias("in_family"))
    same = wanted.join(known, "short").where("parent_module = in_module").withColumn("tier", F.lit(1))
    brought = names.select(F.col("module").alias("parent_module"), F.col("name").alias("first"), F.col("target").alias("from_module"), F.coalesce("symbol", "name").alias("real"))
    through = wanted.withColumn("first", F.when(F.instr("base", ".") > 0, F.substring_index(F.substring_index("base", ".", -2), ".", 1)).otherwise(F.col("base"))).join(brought, ["parent_module", "first"])
    through = through.withColumn("real", F.when(F.instr("base", ".") > 0, F.col("short")).otherwise(F.col("real")))
    through = through.join(known.withColumnRenamed("short", "real"), "real").where("in_module = from_module").withColumn("tier", F.lit(2))
    cols = ["class_id", "pos", "base", "target", "tier"]
    near = same.select(*cols).unionByName(through.select(*cols)).groupBy("class_id", "pos", "tier").agg(F.sort_array(F.collect_set("target")).alias("candidates"))
    near = stored(first_by(near, ["class_id", "pos"], "tier").select("class_id", "pos", "candidates"), "bases-near")
    # only bases that neither the module nor its imports know are looked for everywhere
    open_ = wanted.join(near, ["class_id", "pos"], "left_anti")
    anywhere = open_.join(known, "short").where("family <=> in_family or family is null or in_family is null")
    best = near.unionByName(anywhere.groupBy("class_id", "pos").agg(F.sort_array(F.collect_set("target")).alias("candidates")))
    return wanted.select("class_id", "pos", "base").join(best.select("class_id", "pos", "candidates"), ["class_id", "pos"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def resolve_bases(classes: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, ambiguous): (class_id, bases, resolved_bases, mro, mro_names, mro_error), and bases of several candidates.

    One candidate resolves a base; none or several leave it external, under its name.
    """
    found = stored(base_candidates(classes, names), "bases")
    ambiguous = found.where("size(candidates) > 1").select("class_id", "base", "candidates")
    one = F.when(F.size("candidates") == 1, F.col("candidates")[0])
    rows = found.select("class_id", "pos", one.alias("id"), F.coalesce(one, F.concat(F.lit("external::"), "base")).alias("node"))
    grouped = rows.groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "node"))).alias("b"))
    lists = classes.select(F.col("id").alias("class_id"), "bases").join(grouped, "class_id", "left")
    none = F.array().cast("array<string>")
    lists = lists.select("class_id", "bases", F.coalesce(F.filter(F.transform("b", lambda x: x["id"]), lambda x: x.isNotNull()), none).alias("resolved_bases"), F.coalesce(F.transform("b", lambda x: x["node"]), none).alias("nodes"))
    lists = stored(lists, "base-lists")
    order = mro_operator.orders(lists.select("class_id", F.col("nodes").alias("bases")))
    named = order.select("class_id", "mro", "mro_error", F.transform("mro", lambda x: F.regexp_extract(x, r"([^:.]+)$", 1)).alias("mro_names"))
    return lists.drop("nodes").join(named, "class_id"), ambiguous


def overrides(functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, dst): a method and the method of the nearest class in its class's order that it overrides."""
    methods = first_by(functions.where("parent_class is not null and name <> ''"), ["parent_class", "name"], "line", "id").select("parent_class", "name", "id")
    order = resolved.select("class_id", F.posexplode("mro").alias("pos", "base")).where("pos > 0")
    own = methods.select(F.col("parent_class").alias("class_id"), "name", F.col("id").alias("src"))
    theirs = methods.select(F.col("parent_class").alias("base"), "name", F.col("id").alias("dst"))
    return own.join(order, "class_id").join(theirs, ["base", "name"]).groupBy("src").agg(F.min_by("dst", "pos").alias("dst"))


def method_tables(functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(class_id, name, method): what a name means on a class; the first definition in its order wins."""
    methods = functions.where("parent_class is not null").select(F.col("parent_class").alias("base"), "name", F.col("id").alias("method"))
    order = resolved.select("class_id", F.posexplode("mro").alias("pos", "base"))
    return order.join(methods, "base").groupBy("class_id", "name").agg(F.min(F.struct("pos", "method"))["method"].alias("method"))


def resolve_calls(functions: DataFrame, classes: DataFrame, names: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, name, receiver, line, col, pos, shape, target, tag, reason, confidence), one row a call.

    Bare names: a function of the module, an imported symbol, a method of the own
    class, else builtin or external.  self.m: a method of the own class's order,
    else open.  Upper.m: that class's method if known, else the literal target.
    Other receivers stay open.
    """
    calls = functions.select(F.col("id").alias("src"), "parent_module", "parent_class", F.posexplode(F.concat("calls", F.coalesce("value_refs", F.array().cast("array<struct<name:string,path:array<string>,line:int,col:int>>")))).alias("pos", "c"))
    calls = calls.select("src", "parent_module", "parent_class", "pos", "c.name", F.try_element_at("c.path", F.lit(1)).alias("receiver"), "c.line", "c.col")
    head = F.col("receiver")
    shape = (
        F.when(F.col("name").isin(*sorted(STOPLIST)), "stoplisted").when(head.isNull(), F.when(F.col("name").isin(*sorted(PYTHON_BUILTINS)), "builtin").otherwise("bare"))
        .when(head.isin(*sorted(SELF_NAMES)), "self").when(F.regexp(head, F.lit("^[A-Z][A-Za-z0-9_]*$")), "class").otherwise("receiver")
    )
    calls = calls.withColumn("shape", shape)
    siblings = first_by(functions, ["parent_module", "name"], "line", "id").select("parent_module", "name", F.col("id").alias("sibling"))
    known = symbols(functions, classes)
    brought = names.select(F.col("module").alias("parent_module"), "name", F.coalesce("symbol", "name").alias("real"), F.col("target"))
    brought = brought.join(known.select(F.col("module").alias("target"), F.col("name").alias("real"), F.col("id").alias("imported"), F.col("is_class").alias("imported_class")), ["target", "real"]).select("parent_module", "name", "imported", "imported_class")
    own = known.where("is_class").select(F.col("module").alias("parent_module"), "name", F.col("id").alias("local_class"))
    tables = stored(method_tables(functions, resolved), "methods")
    mine = tables.select(F.col("class_id").alias("parent_class"), "name", F.col("method").alias("mine"))
    heads = own.unionByName(brought.where("imported_class").select("parent_module", "name", F.col("imported").alias("local_class")))
    heads = first_by(heads, ["parent_module", "name"], "local_class").select("parent_module", F.col("name").alias("receiver"), F.col("local_class").alias("head_class"))
    theirs = tables.select(F.col("class_id").alias("head_class"), "name", F.col("method").alias("theirs"))
    out = calls.join(siblings, ["parent_module", "name"], "left").join(brought, ["parent_module", "name"], "left").join(own, ["parent_module", "name"], "left")
    out = out.join(mine, ["parent_class", "name"], "left").join(heads, ["parent_module", "receiver"], "left").join(theirs, ["head_class", "name"], "left")
    outside = F.concat(F.lit("external::"), "name")
    bare = F.coalesce("sibling", "imported", "local_class", "mine")
    target = (
        F.when(F.col("shape") == "bare", F.coalesce(bare, outside)).when(F.col("shape") == "builtin", F.coalesce("sibling", outside)).when(F.col("shape") == "self", F.col("mine"))
        .when(F.col("shape") == "class", F.coalesce("theirs", F.concat("receiver", F.lit("::"), "name")))
    )
    is_class = F.col("sibling").isNull() & (F.coalesce("imported_class", F.lit(False)) | (F.col("imported").isNull() & F.col("local_class").isNotNull()))
    tag = (
        F.when(target.isNull(), "unresolved").when(F.startswith(target, F.lit("external::")), F.when(F.col("shape") == "builtin", "builtin").otherwise("external"))
        .when((F.col("shape") == "bare") & is_class, "constructor").when(F.col("shape") == "class", "method").otherwise("function")
    )
    reason = F.when(tag == "unresolved", F.when(F.col("shape") == "stoplisted", "Stoplisted").when(F.col("shape") == "self", "TypeInferenceRequired").otherwise("NameNotInScope"))
    sure = F.when(tag == "unresolved", 0.0).when(F.col("sibling").isNotNull() | (F.col("shape") == "self"), 0.95).when(F.col("imported").isNotNull(), 0.89).when(F.col("shape") == "class", 0.8).when(F.startswith(target, F.lit("external::")), 0.3).otherwise(0.6)
    return out.select("src", "name", "receiver", "line", "col", "pos", "shape", target.alias("target"), tag.alias("tag"), reason.alias("unresolved_reason"), sure.alias("confidence"))


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct edges of resolved calls."""
    own = calls.where("target is not null").groupBy("src", F.col("target").alias("dst")).agg(F.max("confidence").alias("confidence"), F.min("line").alias("line"))
    return own.select("src", "dst", F.lit("calls").alias("kind"), F.lit("resolved").alias("provenance"), "confidence", "line")


def proximity(a: Column, b: Column) -> Column:
    """Nearness of two paths: 1 in one folder, 0.1 with nothing in common, else 0.3 + 0.3 x the shared part of the longer folder."""
    fa, fb = (F.filter(F.split(F.regexp_replace(x, "/?[^/]*$", ""), "/"), lambda p: p != "") for x in (a, b))
    longest = F.greatest(F.size(fa), F.size(fb))
    both = F.least(F.size(fa), F.size(fb))
    differ = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: F.when((i <= both) & (F.try_element_at(fa, i) == F.try_element_at(fb, i)), F.lit(None).cast("int")).otherwise(i)), lambda i: i.isNotNull())
    common = F.when(F.size(differ) > 0, differ[0] - 1).otherwise(both)
    return F.when((longest == common), 1.0).when(common == 0, 0.1).otherwise(0.3 + 0.3 * common / longest)


def signature_matches(wanted: DataFrame, functions: DataFrame) -> DataFrame:
    """(key, target, score, confidence): the best function of the wanted name (key, name, arity, path).

    Score = 0.4 for the name + 0.3 x likeness of arity + 0.3 x nearness; below 0.5 nothing
    matches, and a name that more than 500 functions bear is declined as ambiguous.
    """
    known = functions.select("name", F.col("id").alias("target"), F.size("parameters").alias("parameters"), F.col("path").alias("target_path"))
    common = known.groupBy("name").count().where(F.col("count") <= CEILING).select("name")
    pairs = wanted.join(common, "name", "left_semi").join(known, "name")
    arity = F.when(F.col("arity") == F.col("parameters"), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("arity") - F.col("parameters")) / F.greatest(F.col("arity"), F.col("parameters"), F.lit(1))))
    scored = pairs.withColumn("score", W_NAME + W_ARITY * arity + W_NEAR * proximity(F.col("path"), F.col("target_path"))).where(F.col("score") >= LEAST)
    best = first_by(scored, ["key"], F.desc("score"), "target")
    return best.select("key", "target", "score", F.least(F.lit(0.79), F.greatest(F.lit(0.40), 0.40 + 0.39 * F.col("score"))).alias("confidence"))


def covered(edges: DataFrame) -> DataFrame:
    """Edges whose target has an edge of its own, or lies outside: targets of unread files are suppressed."""
    sources = edges.select(F.col("src").alias("dst")).distinct()
    inside = edges.join(sources, "dst", "left_semi").select(*edges.columns)
    outside = edges.where(F.startswith("dst", F.lit("external::"))).join(sources, "dst", "left_anti").select(*edges.columns)
    return inside.unionByName(outside)
