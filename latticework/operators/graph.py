"""Walks over typed edges (src, dst, kind).

A walk is a loop over levels: frontier join edges, minus what was visited, one
row a node.  Each level is a stored table, so lineage never grows and a lost
executor costs one level.  Which edge is said to have reached a node is settled
by the order of discovery: the parent's place first, then kind, then upward
before downward, then id.  The place of a node is the list of those choices
along its path, which compares like a global rank but needs no global sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latticework.cluster import stored
from latticework.schema import CALL_LIKE, EDGE_KINDS

DIRECTIONS = {"up": "up", "in": "up", "upstream": "up", "down": "down", "out": "down", "downstream": "down", "both": "both"}
MAX_IMPACT = 20


def edge_kinds(kinds: list[str] | None) -> list[str]:
    """None means every kind; an empty list means none.  Lower case; inherits is extends; a walk over calls follows what frameworks add."""
    if kinds is None:
        return sorted({*EDGE_KINDS, *CALL_LIKE})
    out = {"extends" if k.lower() == "inherits" else k.lower() for k in kinds}
    return sorted(out | (set(CALL_LIKE) if "calls" in out else set()))


def neighbours(edges: DataFrame, kinds: list[str] | None = None, direction: str = "downstream") -> DataFrame:
    """(at, to, kind, way): one row for each step that a walk may take; way 0 goes up, 1 down."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {', '.join(sorted(DIRECTIONS))}, not {direction!r}")
    way = DIRECTIONS[direction]
    own = edges.where(F.col("kind").isin(edge_kinds(kinds)) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    down = own.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind", F.lit(1).alias("way"))
    up = own.select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind", F.lit(0).alias("way"))
    return {"down": down, "up": up}.get(way) if way != "both" else up.unionByName(down)


def _once(steps: DataFrame, max_depth: int) -> DataFrame:
    """The steps as a table of their own where each level would else repeat the joins and groupings they come from."""
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    return stored(steps, "steps") if max_depth > 1 and any(x in plan for x in ("Join", "Aggregate", "Window")) else steps


def _levels(starts: DataFrame, steps: DataFrame, max_depth: int, by: list[str], advance, pick) -> list[DataFrame]:
    """Stored levels of a walk; by: what identifies a visited row, advance and pick: how rows step and which one is kept."""
    level = stored(starts, "walk")
    levels, steps = [level], _once(steps, max_depth)
    for _ in range(max_depth):
        seen = reduce(DataFrame.unionByName, [x.select(*by) for x in levels])
        ahead = advance(level.join(steps, level["id"] == steps["at"])).join(seen, by, "left_anti")
        level = stored(pick(ahead), "walk")
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def traverse(edges: DataFrame, start: str, max_depth: int = 3, kinds: list[str] | None = None, direction: str = "downstream", nodes: DataFrame | None = None) -> DataFrame:
    """(id, depth, edge_type): the start at depth 0 with edge type '', then every node within max_depth.

    With nodes (id, ...), an unknown start gives no rows and unknown ids are left out of the result.
    """
    spark = edges.sparkSession
    steps = neighbours(edges, kinds, direction)
    first = spark.createDataFrame([(start,)], "id string")
    if nodes is not None:
        first = first.join(nodes.select("id").distinct(), "id", "left_semi")
    place = "array<struct<kind:string,way:int,to:string>>"
    first = first.select("id", F.lit(0).alias("depth"), F.lit("").alias("edge_type"), F.from_json(F.lit("[]"), place).alias("place"))

    def advance(rows):
        step = F.array(F.struct("kind", "way", "to"))
        return rows.select(F.col("to").alias("id"), (F.col("depth") + 1).alias("depth"), F.col("kind").alias("edge_type"), F.concat("place", step).alias("place"))

    def pick(rows):
        return rows.groupBy("id").agg(F.min(F.struct("depth", "place", "edge_type")).alias("m")).select("id", "m.depth", "m.edge_type", "m.place")

    levels = _levels(first, steps, max_depth, ["id"], advance, pick)
    out = reduce(DataFrame.unionByName, levels).select("id", "depth", "edge_type")
    return out if nodes is None else out.join(nodes.select("id").distinct(), "id", "left_semi")


def closure(edges: DataFrame, starts: DataFrame, max_depth: int, kinds: list[str] | None = None, direction: str = "downstream") -> DataFrame:
    """(root, id, depth) for every start at once: each node within max_depth of each root, at its least depth."""
    first = starts.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    advance = lambda rows: rows.select("root", F.col("to").alias("id"), (F.col("depth") + 1).alias("depth"))
    return reduce(DataFrame.unionByName, _levels(first, neighbours(edges, kinds, direction), max_depth, ["root", "id"], advance, DataFrame.distinct))


def reachable(edges: DataFrame) -> DataFrame:
    """(root, id): all that each source of edges (src, dst) reaches, at any distance, itself only on a cycle.

    Every round joins the pairs with themselves, so paths of twice the length are found.
    """
    reach = stored(edges.where("src is not null and dst is not null").select(F.col("src").alias("root"), F.col("dst").alias("id")).distinct(), "reach")
    size = reach.count()
    while True:
        further = reach.join(reach.select(F.col("root").alias("id"), F.col("id").alias("to")), "id").select("root", F.col("to").alias("id"))
        reach = stored(reach.unionByName(further).distinct(), "reach")
        now = reach.count()
        if now == size:
            return reach
        size = now


def impact(edges: DataFrame, target: str, max_depth: int = 5) -> DataFrame:
    """(depth, n, ids): what calls the target, directly or not, by distance; depth is capped at 20."""
    reached = traverse(edges, target, min(max_depth, MAX_IMPACT), ["calls"], "upstream").where("depth > 0")
    return reached.groupBy("depth").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 10, kinds: list[str] | None = None) -> DataFrame:
    """(pos, id): the nodes of a shortest path, the first by name of several; no rows without one."""
    first = edges.sparkSession.createDataFrame([(start, [start])], "id string, path array<string>")
    steps = _once(neighbours(edges, kinds, "downstream"), max_depth)
    level, seen = stored(first, "path"), []
    for _ in range(max_depth):
        if not level.where(F.col("id") == end).isEmpty():
            break
        seen.append(level.select("id"))
        ahead = level.join(steps, level["id"] == steps["at"]).select(F.col("to").alias("id"), F.concat("path", F.array("to")).alias("path"))
        level = stored(ahead.join(reduce(DataFrame.unionByName, seen), "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "path")
        if level.isEmpty():
            break
    return level.where(F.col("id") == end).select(F.posexplode("path").alias("pos", "id"))


def unresolved_count(edges: DataFrame, open_calls: DataFrame, start: str, max_depth: int = 3, kinds: list[str] | None = None, direction: str = "downstream") -> DataFrame:
    """(n): how many of open_calls (src, ...) start at a node of the walk; 0 upstream, where nothing is left open."""
    if DIRECTIONS.get(direction) == "up":
        return edges.sparkSession.createDataFrame([(0,)], "n long")
    reached = traverse(edges, start, max_depth, kinds, direction).select(F.col("id").alias("src"))
    return open_calls.join(reached, "src", "left_semi").agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, kinds: tuple[str, ...] = CALL_LIKE) -> DataFrame:
    """(id, caller_count, callee_count, callers, callees): distinct, sorted."""
    own = edges.where(F.col("kind").isin(*kinds)).select("src", "dst").distinct()
    into = own.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("caller_count"), F.sort_array(F.collect_list("src")).alias("callers"))
    out = own.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("callee_count"), F.sort_array(F.collect_list("dst")).alias("callees"))
    none = F.array().cast("array<string>")
    return into.join(out, "id", "full").select("id", F.coalesce("caller_count", F.lit(0)).alias("caller_count"), F.coalesce("callee_count", F.lit(0)).alias("callee_count"), F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def stats(edges: DataFrame) -> DataFrame:
    """(kind, n, sources, targets)."""
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


def one_hop(edges: DataFrame, nodes: DataFrame, node: str, direction: str) -> DataFrame:
    """The entities that call a node (upstream) or that it calls (downstream); unknown ids are left out."""
    near = neighbours(edges, ["calls"], direction).where(F.col("at") == node).select(F.col("to").alias("id")).distinct()
    return nodes.join(near, "id", "left_semi")


def _least_reaching(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, label): the least id from which each node can be reached."""
    label = stored(nodes.select("id", F.col("id").alias("label")), "label")
    while True:
        sent = label.join(arcs, label["id"] == arcs["src"]).select(F.col("dst").alias("id"), "label")
        after = label.unionByName(sent).groupBy("id").agg(F.min("label").alias("label"))
        after = stored(after, "label")
        if after.join(label.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty():
            return after
        label = after


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each strongly connected component; nodes on no cycle stand alone.

    Every round labels nodes with the least id that reaches them; what reaches
    that id back under the same label is its component.  Nodes without an arc in
    or out are split off first.
    """
    arcs = stored(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "scc-arcs")
    nodes = stored(arcs.select(F.col("src").alias("id")).union(arcs.select("dst")).distinct(), "scc-nodes")
    arcs = arcs.where("src <> dst")
    done = []
    while True:
        inner = arcs.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")
        inner = stored(inner, "scc-arcs")
        live = stored(nodes.join(inner.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(inner.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"), "scc-nodes")
        alone = nodes.join(live, "id", "left_anti")
        if not alone.isEmpty():
            done.append(stored(alone.select("id", F.col("id").alias("component")), "scc-done"))
            nodes, arcs = live, inner
            if not live.isEmpty():
                continue
        if live.isEmpty():
            break
        ahead = _least_reaching(live, inner)
        same = inner.join(ahead.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(ahead.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst").where("ls = ld")
        back = _reach(ahead.where("id = label").select("id", "label"), stored(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-back"))
        done.append(back.select("id", F.col("label").alias("component")))
        nodes, arcs = stored(live.join(back, "id", "left_anti"), "scc-nodes"), inner
        if nodes.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def _reach(roots: DataFrame, arcs: DataFrame) -> DataFrame:
    """(id, label): all that the roots reach, each within its own label."""
    level = stored(roots, "scc-reach")
    seen = [level]
    while True:
        ahead = level.join(arcs, level["id"] == arcs["src"]).select(F.col("dst").alias("id"), "label").distinct()
        level = stored(ahead.join(reduce(DataFrame.unionByName, seen), ["id", "label"], "left_anti"), "scc-reach")
        if level.isEmpty():
            return stored(reduce(DataFrame.unionByName, seen), "scc-reached")
        seen.append(level)


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_lw_at", F.row_number().over(w)).where("_lw_at = 1").drop("_lw_at")
