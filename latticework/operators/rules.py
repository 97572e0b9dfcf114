"""Code-quality rules as data: metrics of functions and classes in, findings out.

A rule is a condition over metric columns and severities by tier; all rules of a
scope are evaluated in one pass over its metrics, without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "rule_id string, entity_id string, entity_name string, severity string, message string, signals map<string,double>"


@dataclass(frozen=True)
class Rule:
    """condition and the conditions of tiers are SQL over metrics; the first tier that holds names the severity."""

    rule_id: str
    scope: str  # "function" or "class"
    condition: str
    tiers: tuple[tuple[str, str], ...]
    otherwise: str
    signals: tuple[str, ...]
    message: str


RULES = (
    Rule("god-class", "class", "WMC >= 47 and CBO >= 5", (("Critical", "WMC >= 100"), ("High", "WMC >= 70")), "Medium", ("WMC", "CBO"), "carries too much logic and leans on many classes"),
    Rule("brain-method", "class", "max_method_cyclomatic >= 15 and WMC >= 20", (("Critical", "max_method_cyclomatic >= 30"),), "High", ("max_method_cyclomatic", "WMC"), "has one method that decides nearly everything"),
    Rule("data-class", "class", "field_count >= 5 and WMC <= 10", (("High", "field_count >= 10 and WMC <= 5"),), "Medium", ("field_count", "WMC"), "holds data and hardly any behaviour"),
    Rule("too-many-fields", "class", "field_count >= 10", (("High", "field_count >= 20"),), "Medium", ("field_count",), "has many fields"),
    Rule("long-method", "function", "LOC >= 50 or cyclomatic >= 10", (("High", "LOC >= 100 or cyclomatic >= 20"),), "Medium", ("LOC", "cyclomatic"), "is long or winding"),
    Rule("long-parameter-list", "function", "param_count > 4", (("High", "param_count >= 7"), ("Medium", "param_count >= 6")), "Info", ("param_count",), "takes many parameters"),
    Rule("deep-nesting", "function", "nesting_depth >= 4", (("High", "nesting_depth >= 6"),), "Medium", ("nesting_depth",), "nests deeply"),
    Rule("high-cyclomatic-complexity", "function", "cyclomatic >= 10", (("Critical", "cyclomatic >= 20"),), "High", ("cyclomatic",), "has many branches"),
    Rule("excessive-returns", "function", "return_count > 5", (("High", "return_count >= 8"),), "Medium", ("return_count",), "returns in many places"),
)


def function_metrics(functions: DataFrame) -> DataFrame:
    """(id, name, LOC, param_count, cyclomatic, nesting_depth, return_count); LOC counts both end lines."""
    as_double = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return functions.select(
        "id", "name", as_double(F.greatest(F.lit(0), F.col("exit_line") - F.col("line")) + 1).alias("LOC"), as_double(F.when(F.col("parameters").isNotNull(), F.size("parameters"))).alias("param_count"),
        *[as_double(F.col(c)).alias(c) for c in ("cyclomatic", "nesting_depth", "return_count")],
    )


def coupling(classes: DataFrame, functions: DataFrame, calls: DataFrame, constructors: bool = False) -> DataFrame:
    """(id, CBO): distinct other classes among the resolved bases and the classes of the methods called.

    constructors: whether making an object couples too.
    """
    bases = classes.select("id", F.explode("resolved_bases").alias("other"))
    methods = functions.where("parent_class is not null").select(F.col("id").alias("src"), F.col("parent_class").alias("id"))
    owner = functions.where("parent_class is not null").select(F.col("id").alias("target"), F.col("parent_class").alias("other"))
    called = methods.join(calls.select("src", "target", "tag"), "src")
    through = called.join(owner, "target").select("id", "other")
    made = called.where("tag = 'constructor'").select("id", F.col("target").alias("other"))
    every = bases.unionByName(through)
    every = (every.unionByName(made) if constructors else every).where("id <> other")
    return every.groupBy("id").agg(F.count_distinct("other").cast("double").alias("CBO"))


def class_metrics(classes: DataFrame, functions: DataFrame, cbo: DataFrame) -> DataFrame:
    """(id, name, field_count, WMC, max_method_cyclomatic, CBO)."""
    methods = functions.where("parent_class is not null").groupBy(F.col("parent_class").alias("id")).agg(F.sum("cyclomatic").cast("double").alias("WMC"), F.max("cyclomatic").cast("double").alias("max_method_cyclomatic"))
    out = classes.select("id", "name", F.when(F.col("fields").isNull(), 0).otherwise(F.size("fields")).cast("double").alias("field_count")).join(methods, "id", "left").join(cbo, "id", "left")
    return out.select("id", "name", "field_count", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("WMC", "max_method_cyclomatic", "CBO")])


def _finding(rule: Rule) -> Column:
    severity: Column | None = None
    for name, test in rule.tiers:
        severity = F.when(F.expr(test), name) if severity is None else severity.when(F.expr(test), name)
    severity = F.lit(rule.otherwise) if severity is None else severity.otherwise(rule.otherwise)
    shown = ", ".join(f"{s} %.0f" for s in rule.signals)
    message = F.format_string(f"%s {rule.message} ({shown})", F.col("name"), *[F.col(s) for s in rule.signals])
    signals = F.map_from_arrays(F.array(*[F.lit(s) for s in rule.signals]), F.array(*[F.col(s).cast("double") for s in rule.signals]))
    row = F.struct(F.lit(rule.rule_id).alias("rule_id"), F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), severity.alias("severity"), message.alias("message"), signals.alias("signals"))
    return F.when(F.coalesce(F.expr(rule.condition), F.lit(False)), row)


def findings(metrics: DataFrame, scope: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each rule of the scope that fires on a row of metrics."""
    own = [_finding(r) for r in rules if r.scope == scope]
    if not own:
        return metrics.sparkSession.createDataFrame([], FINDING)
    return metrics.select(F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("f")).select("f.*")


def smells(functions: DataFrame, classes: DataFrame, calls: DataFrame, rules: tuple[Rule, ...] = RULES, entity_id: str | None = None, rule_id: str | None = None) -> DataFrame:
    """Findings of all rules over functions (free ones too) and classes."""
    out = findings(function_metrics(functions), "function", rules).unionByName(findings(class_metrics(classes, functions, coupling(classes, functions, calls)), "class", rules))
    if entity_id is not None:
        out = out.where(F.col("entity_id") == entity_id)
    return out if rule_id is None else out.where(F.col("rule_id") == rule_id)
