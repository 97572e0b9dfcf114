"""Bitemporal ledgers: append-only versions with valid time and transaction time.

A ledger row: key columns, payload, valid_from, tx_time and retired.  A version
holds until the next one of its key; a retired version closes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.schema import OPEN_END

from .graph import first_by, traverse

EDGE_KEY = ["src", "dst", "kind"]


def append(df: DataFrame, path: str) -> None:
    """Add versions to a ledger of Parquet files, partitioned by the day of their transaction."""
    df.withColumn("tx_day", F.to_date("tx_time")).write.mode("append").partitionBy("tx_day").parquet(path)


def assertions(edges: DataFrame, at) -> DataFrame:
    """Ledger rows of edges that hold from a moment on; edges to things outside the graph are not recorded."""
    own = edges.where(~F.startswith("dst", F.lit("external::")) & ~F.startswith("dst", F.lit("builtins.")))
    stamp = F.lit(at).cast("timestamp")
    return own.withColumns({"valid_from": stamp, "tx_time": stamp, "retired": F.lit(False)})


def retire(ledger: DataFrame, gone: DataFrame, keys: list[str], at) -> DataFrame:
    """Closing rows, of moment at, for the keys in gone that are open then."""
    stamp = F.lit(at).cast("timestamp")
    open_ = as_of(ledger, keys, at).join(gone.select(*keys).distinct(), keys, "left_semi")
    return open_.withColumns({"valid_from": stamp, "tx_time": stamp, "retired": F.lit(True)}).select(*ledger.columns)


def timeline(ledger: DataFrame, keys: list[str], end: str = OPEN_END) -> DataFrame:
    """Every version with valid_to, the next version's valid_from; of versions with equal valid_from the last by tx_time holds."""
    last = first_by(ledger, [*keys, "valid_from"], F.desc("tx_time"))
    by = Window.partitionBy(*keys).orderBy("valid_from")
    return last.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(by), F.lit(end).cast("timestamp")))


def as_of(ledger: DataFrame, keys: list[str], at) -> DataFrame:
    """The version of each key that holds at a moment; retired ones are gone.  The moment filters before the shuffle."""
    rows = ledger.where(F.col("valid_from") <= F.lit(at).cast("timestamp"))
    return first_by(rows, keys, F.desc("valid_from"), F.desc("tx_time")).where("not retired")


def reconstruct(ledger: DataFrame, keys: list[str], tx) -> DataFrame:
    """What was known at a transaction time: the last version of each key recorded by then."""
    rows = ledger.where(F.col("tx_time") <= F.lit(tx).cast("timestamp"))
    return first_by(rows, keys, F.desc("tx_time"), F.desc("valid_from")).where("not retired")


def traverse_at(ledger: DataFrame, start: str, at, max_depth: int = 3, kinds: list[str] | None = None, direction: str = "downstream", strict: bool = False) -> DataFrame:
    """A walk over the edges as they were; strict refuses walks that aren't downstream."""
    if strict and direction not in ("down", "downstream", "out"):
        raise NotImplementedError("walks in the past go downstream")
    return traverse(as_of(ledger, EDGE_KEY, at), start, max_depth, kinds, direction)


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, out: str) -> DataFrame:
    """left with the value of the last right row of its key at or before its moment, by one sort of both sides.

    Both sides share a shuffle on the keys; a running last-value replaces any range
    join, so a hot key costs its own rows once.  Of right rows with equal moments
    the largest value counts.
    """
    cols = left.columns
    a = left.select(*[F.col(c) for c in cols], F.col(left_ts).alias("_lw_ts"), F.lit(1).alias("_lw_side"), F.lit(None).cast(right.schema[value].dataType).alias("_lw_value"))
    missing = [c for c in cols if c not in keys]
    b = right.select(*[F.col(k) for k in keys], *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in missing], F.col(right_ts).alias("_lw_ts"), F.lit(0).alias("_lw_side"), F.col(value).alias("_lw_value"))
    w = Window.partitionBy(*keys).orderBy("_lw_ts", "_lw_side", F.col("_lw_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(out, F.last("_lw_value", ignorenulls=True).over(w))
    return both.where("_lw_side = 1").select(*cols, out)
