"""The catalogue: entity tables and edges as DataFrames, and every operator behind one object.

It comes from source trees (analyze), from any relational data mapped to nodes
and edges (from_tables), or from files written earlier (load).
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import stored
from .operators import diff, graph, mutate, resolve, rules, search, temporal
from .plans.query import run, with_joins
from .sources import files as file_source
from .sources import brace_source, frameworks, python_source

TABLES = ("units", "edges", "calls")
ENTITY_COLUMNS = ["id", "kind", "name", "qualified_name", "path", "parent_module", "parent_class", "line", "exit_line", "docstring", "source", "content_hash"]


def _units_of(units: DataFrame, kind: str) -> DataFrame:
    return units.where(F.col("kind") == kind)


def extract(files: DataFrame) -> DataFrame:
    """Units of (path, text, language)."""
    return python_source.extract(files.where("language = 'Python'")).unionByName(brace_source.extract(files))


def resolve_units(units: DataFrame) -> dict[str, DataFrame]:
    """The resolution passes over units: imports, bases and orders, overrides, calls; and all edges they give."""
    modules, functions, classes = (_units_of(units, k) for k in ("module", "function", "class"))
    imports = stored(resolve.resolve_imports(_units_of(units, "import"), modules), "imports")
    names = stored(resolve.imported_names(imports, modules), "names")
    bases, ambiguous = resolve.resolve_bases(classes, names)
    bases = stored(bases, "bases-resolved")
    over = resolve.overrides(functions, bases)
    calls = stored(resolve.resolve_calls(functions, classes, names, bases), "calls")

    def edge(df, src, dst, kind, line="cast(null as int)"):
        return df.selectExpr(f"{src} as src", f"{dst} as dst", f"'{kind}' as kind", "'resolved' as provenance", "1.0d as confidence", f"{line} as line").where("src is not null and dst is not null").dropDuplicates(["src", "dst", "kind"])

    edges = [
        resolve.call_edges(calls).withColumn("confidence", F.col("confidence").cast("double")),
        edge(imports, "parent_module", "resolved_module", "imports", "line"),
        edge(bases.select("class_id", F.explode("resolved_bases").alias("base")), "class_id", "base", "extends"),
        edge(over, "src", "dst", "overrides"),
    ]
    return {"imports": imports, "bases": bases, "calls": calls, "ambiguous_bases": ambiguous, "edges": stored(reduce(lambda a, b: a.unionByName(b), edges), "edges")}


class GraphCatalog:
    def __init__(self, entities: DataFrame, edges: DataFrame, units: DataFrame | None = None, parts: dict[str, DataFrame] | None = None):
        self.entities, self.edges, self.units, self.parts = entities, edges, units, parts or {}
        self.spark = edges.sparkSession

    # -- making, keeping ---------------------------------------------------------------------------------------------
    @classmethod
    def from_units(cls, units: DataFrame, routes: DataFrame | None = None) -> GraphCatalog:
        parts = resolve_units(units)
        entities = units.select(*ENTITY_COLUMNS)
        edges = parts["edges"]
        if routes is not None:
            nodes = routes.selectExpr("node_id as id", "'route' as kind", "name", "name as qualified_name", "path", "concat(path, '::module') as parent_module", "cast(null as string) as parent_class", "line", "line as exit_line", "cast(null as string) as docstring", "cast(null as string) as source", "cast(null as string) as content_hash")
            edges = edges.unionByName(frameworks.route_edges(routes, entities).withColumn("confidence", F.col("confidence").cast("double")))
            entities = entities.unionByName(nodes.dropDuplicates(["id"]))
        return cls(entities, edges, units, parts)

    @classmethod
    def analyze(cls, spark: SparkSession, root: str, ignore: list[str] | None = None) -> GraphCatalog:
        """Every source file below root: Python by its syntax tree, brace languages by a lexer, all by what frameworks declare."""
        tree = stored(file_source.read_tree(spark, root, ignore), "files")
        units = stored(extract(tree), "units")
        return cls.from_units(units, stored(frameworks.routes(tree), "routes"))

    @classmethod
    def from_tables(cls, nodes: DataFrame, edges: DataFrame) -> GraphCatalog:
        """nodes (id, kind, name, ...) and edges (src, dst, kind, ...)."""
        return cls(nodes, edges)

    def save(self, path: str) -> None:
        for name in ("entities", "edges", "units"):
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphCatalog:
        try:
            units = spark.read.parquet(f"{path}/units")
        except Exception as e:  # a catalogue of plain tables has none
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return cls(spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/edges"))
        return cls(spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/edges"), units, resolve_units(units))

    # -- views of the query language ---------------------------------------------------------------------------------
    @cached_property
    def views(self) -> dict:
        """Views by entity; each takes the names that a query reads and joins only what those need."""
        edges = self.edges
        degree = lambda *columns: lambda: graph.degrees(edges).select("id", *columns)
        counts, lists = ("caller_count", "callee_count"), ("callers", "callees")
        degrees = [(["id"], counts, degree(*counts), 0), (["id"], lists, degree(*lists), None)]
        if self.units is None:
            nodes = lambda names: with_joins(self.entities, names, degrees)
            return {k: nodes for k in ("functions", "classes", "modules", "fields", "imports")} | {"calls": edges}
        u = self.units

        def count(kind, key, name):
            return lambda: _units_of(u, kind).groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name))

        def module_names():
            dotted = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.[A-Za-z0-9]+$", ""), "/__init__$", ""), "/", ".")
            return _units_of(u, "module").select(F.col("id").alias("parent_module"), dotted.alias("module_name"))

        def overrides():
            over = edges.where("kind = 'overrides'").groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("a"))
            return over.select("id", F.array_distinct(F.concat("a", F.transform("a", lambda x: F.regexp_extract(x, r"([^:]+)$", 1)))).alias("overrides"))

        def methods():
            own = _units_of(u, "function").where("parent_class is not null").groupBy(F.col("parent_class").alias("id"))
            return own.agg(F.sort_array(F.collect_set("name")).alias("method_names"), F.count("*").alias("method_count"))

        functions = _units_of(u, "function").select(
            "id", "name", "qualified_name", "path", "parent_module", "parent_class", "line", "exit_line", (F.col("exit_line") - F.col("line")).alias("line_count"), "is_async", "is_generator", "decorators", F.col("function_kind").alias("kind"),
            F.size("parameters").alias("parameter_count"), "return_type", "docstring", "cyclomatic", "nesting_depth", "return_count",
        )
        setters = lambda: _units_of(u, "function").where("function_kind = 'Setter'").select("parent_class", "name", F.lit(True).alias("has_setter")).distinct()
        module = (["parent_module"], ("module_name",), module_names, None)
        targets = (["id"], ("resolved_call_targets",), lambda: graph.degrees(edges).select("id", F.col("callees").alias("resolved_call_targets")), None)
        function_joins = [*degrees, targets, module, (["id"], ("overrides",), overrides, None), (["parent_class", "name"], ("has_setter",), setters, False)]
        classes = _units_of(u, "class").select("id", "name", "qualified_name", "path", "parent_module", "line", "exit_line", "decorators", "grammar_kind", "docstring", F.col("bases").alias("inherits_from"), F.size("fields").alias("field_count"), "is_dataclass")
        order = lambda: self.parts["bases"].select(F.col("class_id").alias("id"), "resolved_bases", "mro", "mro_names", "mro_error")
        subs = lambda: edges.where("kind = 'extends'").groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("src")).alias("subclasses"))
        class_joins = [(["id"], ("method_names", "method_count"), methods, 0), (["id"], ("resolved_bases", "mro", "mro_names", "mro_error"), order, None), (["id"], ("subclasses",), subs, None), module]
        modules = _units_of(u, "module").select("id", "name", "path", "language", "star_exports", "docstring", "content_hash")
        module_joins = [(["id"], (name,), count(kind, "parent_module", name), 0) for kind, name in (("class", "class_count"), ("function", "function_count"), ("import", "import_count"))]
        imports = self.parts["imports"].select("id", "raw", F.col("import_kind").alias("kind"), "module", "level", "line", "is_type_only", "path", "parent_module", "resolved_module", F.coalesce("resolved_module", "module").alias("resolved_target"), "target_kind")
        kinds = lambda: self.entities.where("kind in ('function', 'class')").select(F.col("id").alias("target"), F.col("kind").alias("target_kind"))
        calls = self.parts["calls"].select(F.col("src").alias("source"), "target", "name", "receiver", "line", "tag", "unresolved_reason", "confidence")
        fields = _units_of(u, "class").select(F.col("id").alias("parent_class"), F.explode("fields").alias("f")).select(F.concat_ws(".", "parent_class", "f.name").alias("id"), "f.name", "parent_class", "f.type_annotation", "f.is_class_var", "f.line")
        return {
            "functions": lambda names: with_joins(functions, names, function_joins), "classes": lambda names: with_joins(classes, names, class_joins), "modules": lambda names: with_joins(modules, names, module_joins),
            "imports": imports, "calls": lambda names: with_joins(calls, names, [(["target"], ("target_kind",), kinds, "external")]), "fields": fields,
        }

    def query(self, text: str) -> DataFrame:
        return run(text, self.views)

    # -- graph ---------------------------------------------------------------------------------------------------------
    def lookup(self, entity_id: str) -> DataFrame:
        rank = F.array_position(F.array(*[F.lit(k) for k in ("function", "class", "module", "import", "constant", "type_alias")]), F.col("kind"))
        return self.entities.where(F.col("id") == entity_id).orderBy(F.when(rank == 0, 99).otherwise(rank)).limit(1)

    def traverse(self, start: str, max_depth: int = 3, kinds: list[str] | None = None, direction: str = "downstream") -> DataFrame:
        return graph.traverse(self.edges, start, max_depth, kinds, direction, self.entities)

    def traverse_unresolved(self, start: str, max_depth: int = 3, kinds: list[str] | None = None, direction: str = "downstream") -> DataFrame:
        """(n): calls to outside or unresolved targets, and imports that lead nowhere, from the nodes of a walk."""
        open_ = self.parts["calls"].where("tag in ('external', 'unresolved') and shape <> 'stoplisted'").select("src")
        open_ = open_.unionByName(self.parts["imports"].where("target_kind = 'unresolved'").select(F.col("parent_module").alias("src")))
        return graph.unresolved_count(self.edges, open_, start, max_depth, kinds, direction)

    def callers_of(self, entity_id: str) -> DataFrame:
        return graph.one_hop(self.edges, self.entities, entity_id, "upstream")

    def callees_of(self, entity_id: str) -> DataFrame:
        return graph.one_hop(self.edges, self.entities, entity_id, "downstream")

    def module_children(self, module_id: str) -> DataFrame:
        return self.entities.where((F.col("parent_module") == module_id) & (F.col("id") != module_id))

    def affected(self, entity_id: str, max_depth: int = 5) -> DataFrame:
        return graph.impact(self.edges, entity_id, max_depth)

    def call_chain(self, start: str, end: str, max_depth: int = 10) -> DataFrame:
        return graph.shortest_path(self.edges, start, end, max_depth, ["calls"])

    def stats(self) -> DataFrame:
        return graph.stats(self.edges)

    def register_edge(self, src: str, dst: str, kind: str, confidence: float = 1.0) -> None:
        """Add a heuristic edge; a walk over calls follows the kinds that frameworks use."""
        row = self.spark.createDataFrame([(src, dst, kind.lower(), "heuristic", float(confidence), None)], "src string, dst string, kind string, provenance string, confidence double, line int")
        self.edges = self.edges.unionByName(row, allowMissingColumns=True)
        self.__dict__.pop("views", None)

    # -- search, rules, edits --------------------------------------------------------------------------------------------
    def find(self, name: str, top_k: int = 10, kind: str | None = None) -> DataFrame:
        return search.search_names(self.entities, name, top_k, kind)

    def search_similar(self, vectors: DataFrame, query: list[float], top_k: int = 10) -> DataFrame:
        return search.search_vectors(vectors, query, top_k).join(self.entities.select("id", "name", "kind"), "id").orderBy(F.desc("similarity"), "id")

    def smells(self, entity_id: str | None = None, rule_id: str | None = None) -> DataFrame:
        classes = _units_of(self.units, "class").join(self.parts["bases"].select(F.col("class_id").alias("id"), "resolved_bases"), "id", "left")
        return rules.smells(_units_of(self.units, "function"), classes, self.parts["calls"], entity_id=entity_id, rule_id=rule_id)

    def plan_rename(self, entity_id: str, new_name: str) -> DataFrame:
        return mutate.rename(self.units, self.parts["calls"], entity_id, new_name)

    def plan_body_replacement(self, entity_id: str, body: str) -> DataFrame:
        return mutate.replace_body(self.units, entity_id, body)

    def plan_signature_update(self, entity_id: str, signature: str) -> DataFrame:
        return mutate.update_signature(self.units, self.parts["calls"], entity_id, signature)

    # -- time ------------------------------------------------------------------------------------------------------------
    def ledger(self, at) -> DataFrame:
        return temporal.assertions(self.edges, at)

    def updated(self, changed: DataFrame) -> GraphCatalog:
        """The catalogue after files (path, text) changed; a null text removes the file.  Resolution runs over all units again."""
        rest = diff.remove_files(self.units, changed)
        fresh = extract(file_source.with_language(changed.where("text is not null")))
        return GraphCatalog.from_units(stored(rest.unionByName(fresh), "units"))
