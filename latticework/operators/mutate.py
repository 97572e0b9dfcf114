"""Edit plans: which bytes of which files an edit would change, as rows.

Planning is distributed and changes nothing; apply() runs on the driver, checks
that files still are what was planned against, and puts all back if any edit
fails.  Edits: (path, start, end, new_text, content_hash, verified, reason).
"""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.sources.python_source import digest, units

COLUMNS = ["path", "start", "end", "new_text", "content_hash", "verified", "reason"]
MAX_FILES, MAX_EDITS = 100, 500


def _files(units_: DataFrame) -> DataFrame:
    return units_.where("kind = 'module'").select("path", F.col("content_hash").alias("file_hash"), F.col("source").alias("file_text"))


def _own(units_: DataFrame, entity_id: str, span: str, new_text: str) -> DataFrame:
    own = units_.where(F.col("id") == entity_id).select("path", F.col(f"{span}.start").alias("start"), F.col(f"{span}.end").alias("end"))
    own = own.join(_files(units_).select("path", F.col("file_hash").alias("content_hash")), "path")
    return own.select("path", "start", "end", F.lit(new_text).alias("new_text"), "content_hash", F.lit(True).alias("verified"), F.lit("definition").alias("reason"))


def replace_body(units_: DataFrame, entity_id: str, body: str) -> DataFrame:
    return _own(units_, entity_id, "body_span", body)


def _call_sites(units_: DataFrame, calls: DataFrame, entity_id: str) -> DataFrame:
    """(path, start, line, receiver, name, content_hash) of the calls that lead to an entity, in bytes."""
    at = calls.where(F.col("target") == entity_id).select("src", "line", "col", "receiver", "name")
    where = at.join(units_.select(F.col("id").alias("src"), "path"), "src").join(_files(units_), "path")
    before = F.slice(F.split("file_text", "\n"), F.lit(1), F.col("line") - 1)
    start = F.aggregate(before, F.lit(0).cast("bigint"), lambda s, x: s + F.octet_length(x) + 1) + F.col("col")
    return where.select("path", start.cast("int").alias("start"), "line", "receiver", "name", F.col("file_hash").alias("content_hash"))


def rename(units_: DataFrame, calls: DataFrame, entity_id: str, new_name: str) -> DataFrame:
    """The definition and its bare call sites; calls through a receiver are listed as unverified."""
    sites = _call_sites(units_, calls, entity_id)
    bare = F.col("receiver").isNull()
    uses = sites.select("path", "start", (F.col("start") + F.when(bare, F.octet_length("name")).otherwise(0)).alias("end"), F.lit(new_name).alias("new_text"), "content_hash", bare.alias("verified"), F.when(bare, "call").otherwise("attribute call").alias("reason"))
    return _own(units_, entity_id, "name_span", new_name).unionByName(uses).distinct()


def update_signature(units_: DataFrame, calls: DataFrame, entity_id: str, signature: str) -> DataFrame:
    """The text from def to the body replaced; every call site is listed as unverified."""
    own = units_.where(F.col("id") == entity_id).select("path", F.col("span.start").alias("start"), F.col("body_span.start").alias("body"), "source")
    own = own.join(_files(units_), "path")
    head = F.expr("substring(cast(file_text as binary), start + 1, body - start)").cast("string")
    length = F.octet_length(F.regexp_extract(head, r"(?s)^(.*:)[^:]*$", 1))
    definition = own.select("path", "start", (F.col("start") + length).alias("end"), F.lit(signature).alias("new_text"), F.col("file_hash").alias("content_hash"), F.lit(True).alias("verified"), F.lit("definition").alias("reason"))
    sites = _call_sites(units_, calls, entity_id).select("path", "start", F.col("start").alias("end"), F.lit(None).cast("string").alias("new_text"), "content_hash", F.lit(False).alias("verified"), F.lit("call").alias("reason"))
    return definition.unionByName(sites).distinct()


def create(units_: DataFrame, path: str, text: str, after: str | None = None, top: bool = False) -> DataFrame:
    """New text at the end of a file, at its top, or after an entity."""
    if after:
        at = units_.where((F.col("id") == after) & (F.col("path") == path)).select("path", F.col("span.end").alias("at"))
    else:
        at = _files(units_).where(F.col("path") == path).select("path", (F.lit(0) if top else F.octet_length("file_text")).alias("at"))
    new = ("" if top else "\n\n") + text.rstrip("\n") + ("\n\n" if top else "\n")
    return at.join(_files(units_), "path").select("path", F.col("at").cast("int").alias("start"), F.col("at").cast("int").alias("end"), F.lit(new).alias("new_text"), F.col("file_hash").alias("content_hash"), F.lit(True).alias("verified"), F.lit("new").alias("reason"))


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits in bytes, applied from the end; overlapping ones are an error."""
    raw = text.encode()
    last = len(raw) + 1
    for start, end, new in sorted(edits, reverse=True):
        if end > last:
            raise ValueError("edits overlap")
        raw, last = raw[:start] + new.encode() + raw[end:], start
    return raw.decode()


def apply(plan: DataFrame, root: str, allowed: tuple[str, ...] = ("*",), denied: tuple[str, ...] = ()) -> list[str]:
    """Carry out a plan's verified edits below root; the paths written.  A plan is small: at most MAX_FILES files and MAX_EDITS edits."""
    from fnmatch import fnmatch

    rows = plan.where("verified").select(*COLUMNS).limit(MAX_EDITS + 1).collect()
    paths = sorted({r["path"] for r in rows})
    if len(rows) > MAX_EDITS or len(paths) > MAX_FILES:
        raise ValueError("the plan is larger than the limits allow")
    for p in paths:
        if any(fnmatch(p, d) for d in denied) or not any(fnmatch(p, a) for a in allowed):
            raise PermissionError(p)
    before = {p: Path(root, p).read_text() for p in paths}
    for r in rows:
        if digest(before[r["path"]]) != r["content_hash"]:
            raise ValueError(f"{r['path']} changed since the plan was made")
    done = []
    try:
        for p in paths:
            text = edited(before[p], [(r["start"], r["end"], r["new_text"]) for r in rows if r["path"] == p])
            if p.endswith(".py") and any(u.get("error") for u in units(p, text)):
                raise ValueError(f"{p} would no longer parse")
            _write(Path(root, p), text)
            done.append(p)
    except Exception:
        for p in done:
            _write(Path(root, p), before[p])
        raise
    return done


def _write(path: Path, text: str) -> None:
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as f:
        f.write(text)
    os.replace(name, path)
