"""Source trees as tables: one row a file, with its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.schema import FILENAMES, IGNORED_PARTS, LANGUAGES


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, *v) for e, v in sorted(LANGUAGES.items())], "extension string, language string, tier int, family string")


def with_language(files: DataFrame) -> DataFrame:
    """Adds language, tier and family by extension, else by file name; unknown files keep nulls."""
    named = F.create_map(*[F.lit(x) for kv in sorted(FILENAMES.items()) for x in kv])
    key = F.when(extension(F.col("path")).isin(*LANGUAGES), extension(F.col("path"))).otherwise(named[file_name(F.col("path"))])
    table = languages(files.sparkSession).withColumnRenamed("extension", "_lw_ext")  # a fixed table of a few dozen rows
    return files.withColumn("_lw_ext", key).join(F.broadcast(table), "_lw_ext", "left").drop("_lw_ext")


def ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Whether a path lies in a folder that is never source, or matches one of the ignore patterns (*, ?, trailing /)."""
    out = F.lit(False)
    for part in IGNORED_PARTS:
        out = out | F.contains(F.concat(F.lit("/"), path), F.lit(part))
    for p in patterns or []:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if c in ".+()[]{}^$|\\" else c) for c in p.strip("/"))
        out = out | F.regexp(path, F.lit(("^" if p.startswith("/") else "(^|/)") + body + ("/" if p.endswith("/") else "(/|$)")))
    return out


def read_tree(spark: SparkSession, root: str, patterns: list[str] | None = None, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """(path relative to root, text, language, tier, family) of the files of known language below root.  Unreadable files are skipped."""
    glob = "*" if not suffixes else "*.{" + ",".join(suffixes) + "}"
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true")
    raw = reader.text(root, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("full"))
    base = root.rstrip("/").removeprefix("file:").removeprefix("//")
    path = F.regexp_replace(F.regexp_replace("full", "^file:/*", "/"), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    files = raw.select(path.alias("path"), "text")
    return with_language(files.where(~ignored(F.col("path"), patterns))).where("language is not null")
