"""Method resolution order: C3 linearisation of every class, each from its own ancestors.

The ancestors come from joining extends to itself until nothing is added, so a
hierarchy of any height takes as many rounds as its logarithm; every class then brings the ordered bases of its ancestors to one Arrow batch row and is
linearised by itself, so the work spreads over classes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.cluster import ship

from .graph import reachable


def merge(lists: list[list[str]]) -> tuple[list[str], bool]:
    """C3 merge; where no head is free the first head is taken anyway and the order counts as inconsistent."""
    out, sound = [], True
    lists = [list(x) for x in lists if x]
    while lists:
        head = next((x[0] for x in lists if not any(x[0] in y[1:] for y in lists)), None)
        if head is None:
            head, sound = lists[0][0], False
        out.append(head)
        lists = [z for x in lists if (z := [y for y in x if y != head])]
    return out, sound


def linearise(start: str, bases: dict[str, list[str]]) -> tuple[list[str], bool]:
    """(order, error): with a cycle among the ancestors the order is the class and what it reaches, breadth first."""
    done: dict[str, list[str]] = {}
    open_: set[str] = set()
    sound = True

    def cyclic() -> list[str]:
        seen, queue = [start], [start]
        for x in queue:
            for b in bases.get(x, []):
                if b not in seen:
                    seen.append(b)
                    queue.append(b)
        return seen

    stack = [(start, False)]
    while stack:
        x, ready = stack.pop()
        if x in done:
            continue
        if ready:
            tail, ok = merge([*(done[b] for b in bases.get(x, [])), bases.get(x, [])])
            done[x], sound = [x, *tail], sound and ok
            open_.discard(x)
            continue
        open_.add(x)
        stack.append((x, True))
        for b in reversed(bases.get(x, [])):
            if b in open_:
                return cyclic(), True
            if b not in done:
                stack.append((b, False))
    return done[start], not sound


def orders(bases: DataFrame) -> DataFrame:
    """(class_id, mro, mro_error) of (class_id, bases array<string>): bases in order of declaration, unknown ones by name."""
    own = bases.select("class_id", F.coalesce("bases", F.array().cast("array<string>")).alias("bases"))
    edges = own.select(F.col("class_id").alias("src"), F.explode("bases").alias("dst"), F.lit("extends").alias("kind"))
    reach = reachable(edges).unionByName(own.select(F.col("class_id").alias("root"), F.col("class_id").alias("id"))).distinct()
    reach = reach.join(own.select(F.col("class_id").alias("root")), "root", "left_semi")
    parts = reach.join(own.select(F.col("class_id").alias("id"), "bases"), "id")
    family = parts.groupBy("root").agg(F.collect_list(F.struct("id", "bases")).alias("family"))
    ship(bases.sparkSession)
    schema = pa.schema([("class_id", pa.string()), ("mro", pa.list_(pa.string())), ("mro_error", pa.bool_())])

    def run(batches):
        for b in batches:
            roots = b.column(0).to_pylist()
            found = [linearise(r, {x["id"]: x["bases"] for x in f}) for r, f in zip(roots, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], schema.field(1).type), pa.array([f[1] for f in found], pa.bool_())], schema=schema)

    return family.mapInArrow(run, "class_id string, mro array<string>, mro_error boolean")
