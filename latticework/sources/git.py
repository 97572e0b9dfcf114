"""What git knows of a work tree, as tables.  git itself runs on the driver: a work tree is one machine's."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, timeout=300).stdout


def changed_files(spark: SparkSession, root: str, old: str, new: str = "HEAD") -> DataFrame:
    """(status, path) between two commits; a rename is a removal and an addition."""
    parts = _git(root, "diff", "--name-status", "--no-renames", "-z", old, new).split("\0")
    return spark.createDataFrame(list(zip(parts[0:-1:2], parts[1::2])), "status string, path string")


def blame(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(line, commit, author, at) of a file."""
    rows, commit, seen = [], None, {}
    for text in _git(root, "blame", "--porcelain", "--", path).split("\n"):
        head = text.split(" ")
        if text.startswith("\t"):
            rows.append((line, commit, seen[commit].get("author"), int(seen[commit].get("author-time", 0))))
        elif len(head[0]) == 40 and len(head) >= 3:
            commit, line = head[0], int(head[2])
            seen.setdefault(commit, {})
        elif commit:
            seen[commit][head[0]] = text[len(head[0]) + 1 :]
    return spark.createDataFrame(rows, "line int, commit string, author string, at_s long").selectExpr("line", "commit", "author", "timestamp_seconds(at_s) as at")


def is_clean(root: str) -> bool:
    return not _git(root, "status", "--porcelain").strip()


def branch(root: str) -> str:
    return _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
