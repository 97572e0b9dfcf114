"""What changed between two states of a file's units, and which dependents that touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = {"insert": 0, "modify": 1, "remove": 2}


def unit_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind, qualified_name, op, change, id, pos): inserts, then modifications, then removals.

    A unit is the same if its path, kind and qualified name are; change says whether
    its signature or only its body differs.  Unchanged units give no row.
    """
    keys = ["path", "kind", "qualified_name"]
    side = lambda df, s: df.groupBy(*keys).agg(F.min("id").alias(f"id_{s}"), F.min(F.coalesce("signature_hash", F.lit(""))).alias(f"sig_{s}"), F.min(F.coalesce("body_hash", "content_hash", F.lit(""))).alias(f"body_{s}"))
    both = side(old, "o").join(side(new, "n"), keys, "full")
    op = F.when(F.col("id_o").isNull(), "insert").when(F.col("id_n").isNull(), "remove").when((F.col("sig_o") != F.col("sig_n")) | (F.col("body_o") != F.col("body_n")), "modify")
    change = F.when(op == "modify", F.when(F.col("sig_o") != F.col("sig_n"), "signature").otherwise("body"))
    place = F.when(op == "insert", 0).when(op == "modify", 1).otherwise(2)
    return both.withColumn("op", op).where("op is not null").select(*keys, "op", change.alias("change"), F.coalesce("id_n", "id_o").alias("id"), place.alias("pos"))


def affected_files(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(path): files with a call or base in one of the given files (path); their own edges have to be made again."""
    into = edges.select(F.regexp_extract("src", r"^(.*)::[^:]*$", 1).alias("path"), F.regexp_extract("dst", r"^(.*)::[^:]*$", 1).alias("to"))
    return into.join(paths.select(F.col("path").alias("to")).distinct(), "to", "left_semi").select("path").distinct()


def remove_files(units: DataFrame, paths: DataFrame) -> DataFrame:
    return units.join(paths.select("path").distinct(), "path", "left_anti").select(*units.columns)


def dangling(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges without those that start or end at an entity that is gone; outside targets stay."""
    known = entities.select("id").distinct()
    live = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi")
    outside = F.startswith("dst", F.lit("external::")) | ~F.contains("dst", F.lit("::"))
    return live.where(~outside).join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns).unionByName(live.where(outside).select(*edges.columns))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, op) of two states of any keyed table."""
    a = old.select(*keys, F.col(value).alias("v_old"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.col(value).alias("v_new"), F.lit(True).alias("in_new"))
    op = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "remove").when(~F.col("v_old").eqNullSafe(F.col("v_new")), "modify")
    return a.join(b, keys, "full").withColumn("op", op).where("op is not null").select(*keys, "op")
