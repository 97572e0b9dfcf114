"""Near-duplicate embeddings by cross-polytope hashing.

Vectors are scaled to length 1 and padded to a power of two.  Each of TABLES x
HASHES rotations is three rounds of random signs and a fast Hadamard
transform; a hash is the vertex of the cross-polytope next to the rotated
vector, that is the index and sign of its largest coordinate.  HASHES of them
name a bucket of a table.  Multiprobe: a vector also looks into the PROBES
buckets that differ in one hash and lose least.  Vectors of which one looks
where the other lives share the bucket's leader, its smallest member.

Candidates under a leader are verified by their exact cosine, without a row a
pair.  A group of at most NODES vectors is one product of matrices.  A larger
one is spread over blocks, each of which meets the leader first: those within
the threshold of it are connected by that, and only the others meet the whole
group, block by block.  So a cluster of any size costs one cosine a vector as
far as it lies around its leader, and the classes are the same as if every
candidate pair had been verified.

Equal vectors collapse before hashing, so thousands of copies cost one row
each.  On unit vectors of 64 dimensions pairs with cosine 0.9 are found with a
recall above 0.99; no bucket or candidate list is cut.

Defined results: null ids are left out; null, empty, zero and non-finite
vectors and vectors with null elements are near nothing; vectors of different
lengths are never near; an id that stands on several vectors joins the classes
of all of them; rows with equal ids and vectors count once; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, U64, arrow_map, in_chunks, mix, runs, stored
from .tiles import KEY, components, each_tile

T = 0.9
TABLES, HASHES, PROBES, ROUNDS = 12, 3, 4, 3
#: Vectors of a block; rows of a product of matrices.
NODES, BLOCK = 2048, 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows transformed by the unscaled Hadamard matrix of their width, a power of two, in n log n steps."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d)


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """Keys (rows x tables) of the buckets where vectors live, and (rows x tables x probes) where they also look."""
    n, d = unit.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, wide), np.float32)
    padded[:, :d] = unit
    rng = np.random.default_rng([7, d])
    home = np.zeros((n, tables), U64)
    also = np.zeros((n, tables, probes), U64)
    ranks = min(3, wide)
    for t in range(tables):
        vertex, loss = [], []
        for _ in range(hashes):
            y = padded
            for _ in range(ROUNDS):
                y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), wide)) / np.float32(np.sqrt(wide))
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, :ranks]
            size = np.take_along_axis(size, top, 1)
            vertex.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
            loss.append(size[:, :1] ** 2 - size**2)
        parts = [v.astype(U64) for v in vertex]
        weight = [U64(pow(0x9E3779B97F4A7C15, i + 2, 1 << 64)) for i in range(hashes)]
        total = np.full(n, (d * 1_000_003 + t) * 0xD6E8FEB86659FD93 & MASK64, U64)
        for p, w in zip(parts, weight):
            total = total + p[:, 0] * w
        home[:, t] = mix(total)
        other = np.concatenate([total[:, None] + (p[:, 1:] - p[:, :1]) * w for p, w in zip(parts, weight)], axis=1)
        cost = np.concatenate([x[:, 1:] for x in loss], axis=1)
        pick = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        also[:, t, : pick.shape[1]] = mix(np.take_along_axis(other, pick, 1))
        also[:, t, pick.shape[1] :] = home[:, t, None]
    return home, also


def _unit(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors are usable, and the usable ones scaled to length 1."""
    good, out = [], []
    for v in vectors:
        x = np.array([np.nan], float) if v is None or any(e is None for e in v) else np.asarray(v, float)
        n = np.linalg.norm(x)
        good.append(bool(len(x) and np.isfinite(n) and n > 0))
        if good[-1]:
            out.append(x / n)
    return np.array(good, bool), out


def _hash(batches):
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("home", pa.bool_())])
    for b in batches:
        ids = b.column("node").to_numpy(zero_copy_only=False)
        good, unit = _unit(b.column("vec").to_pylist())
        ids = ids[good]
        size = np.array([len(u) for u in unit])
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            home, also = buckets(np.stack([unit[i] for i in at]))
            n = len(at)
            key = np.concatenate([home.ravel(), also.ravel()]).astype(np.int64)
            who = np.concatenate([np.repeat(ids[at], TABLES), np.repeat(ids[at], TABLES * PROBES)])
            yield from in_chunks([key, who, np.arange(len(key)) < n * TABLES], schema.names, schema)


def _leaders(batches):
    """(node, leader) of the buckets in which a vector lives and another looks or lives.

    Rows come sorted by bucket, those who live there first: the first of a bucket leads it, and nothing is held.
    """
    schema = pa.schema([("node", pa.int64()), ("leader", pa.int64())])
    last, lead, lives = None, 0, False  # the bucket that the batch before ended in
    for b in batches:
        key, node, home = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        start, count = runs(key)
        first, alive = node[start], home[start].astype(bool)
        if key[0] == last:
            first[0], alive[0] = lead, lives
        last, lead, lives = key[-1], first[-1], alive[-1]
        led = np.repeat(first, count)
        keep = np.repeat(alive, count) & (led != node)
        own, led = node[keep], led[keep]
        o = np.lexsort((led, own))
        own, led = own[o], led[o]
        once = np.r_[True, (own[1:] != own[:-1]) | (led[1:] != led[:-1])] if len(own) else np.zeros(0, bool)
        yield from in_chunks([own[once], led[once]], schema.names, schema)


def _table(tile: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Nodes, and (places, unit vectors) for each length."""
    node = tile.column("node").to_numpy()
    _, unit = _unit(tile.column("vec").to_pylist())
    size = np.array([len(u) for u in unit])
    return node, [(at, np.stack([unit[i] for i in at])) for d in np.unique(size) for at in [np.flatnonzero(size == d)]]


EDGES = pa.schema([("doc_a", pa.int64()), ("doc_b", pa.int64())])


def _whole(t: float):
    """Edges that connect the nodes of a group as its near pairs do, at most one a node."""

    def run(batches):
        for tile in each_tile(batches):
            node, parts = _table(tile)
            for at, x in parts:
                label = np.arange(len(at))
                for i in range(0, len(at), BLOCK):
                    near = x[i : i + BLOCK] @ x.T >= t
                    for k, row in enumerate(near, i):
                        row[k] = True
                        seen = np.unique(label[row])
                        for other in seen[1:]:
                            label[label == other] = seen[0]
                moved = np.flatnonzero(label != np.arange(len(at)))
                yield from in_chunks([node[at][label[moved]], node[at][moved]], EDGES.names, EDGES)

    return run


def _to_leader(t: float):
    """(leader, node, near) of a block of a large group, the leader's own row among it."""
    schema = pa.schema([("leader", pa.int64()), ("node", pa.int64()), ("near", pa.bool_())])

    def run(batches):
        for tile in each_tile(batches):
            node, parts = _table(tile)
            lead = tile.column("leader")[0].as_py()
            near = np.zeros(len(node), bool)
            for at, x in parts:
                if (own := np.flatnonzero(node[at] == lead)).size:
                    near[at] = x @ x[own[0]] >= t
            yield from in_chunks([np.full(len(node), lead), node, near], schema.names, schema)

    return run


def _across(t: float):
    """As _whole, for the near pairs of a block of far nodes and a block of any nodes."""

    def run(batches):
        for tile in each_tile(batches):
            far = tile.column("far").to_numpy(zero_copy_only=False).astype(bool)
            node, parts = _table(tile)
            for at, x in parts:
                a, b = np.flatnonzero(far[at]), np.flatnonzero(~far[at])
                known, place = np.unique(node[at], return_inverse=True)
                label = np.arange(len(known))
                for i in range(0, len(a), BLOCK):
                    near = x[a[i : i + BLOCK]] @ x[b].T >= t
                    for k in np.flatnonzero(near.any(axis=1)):
                        seen = np.unique(label[np.r_[place[a[i + k]], place[b[near[k]]]]])
                        for other in seen[1:]:
                            label[label == other] = seen[0]
                moved = np.flatnonzero(label != np.arange(len(known)))
                yield from in_chunks([known[label[moved]], known[moved]], EDGES.names, EDGES)

    return run


def _edges(nodes: DataFrame, t: float) -> DataFrame:
    """Edges that connect the near candidates among nodes (node, vec)."""
    led = stored(arrow_map(arrow_map(nodes, _hash, "key long, node long, home boolean").repartition("key").sortWithinPartitions("key", F.desc("home"), "node"), _leaders, "node long, leader long").distinct(), "op7-looks")
    led = stored(led.unionByName(led.select(F.col("leader").alias("node"), "leader")).distinct(), "op7-led")
    k = F.ceil(F.count("*") / NODES).cast("int").alias("k")
    size = stored(led.groupBy("leader").agg(k), "op7-groups")
    small = led.join(size.where("k = 1").select("leader"), "leader").join(nodes, "node").select("leader", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", "vec")
    edges = arrow_map(small.repartition(*KEY).sortWithinPartitions(*KEY), _whole(t), "doc_a long, doc_b long")
    if not size.where("k > 1").limit(1).count():
        return edges
    block = F.pmod(F.xxhash64("node"), "k").cast("int")
    large = led.join(size.where("k > 1"), "leader").withColumn("lo", block)
    each = large.where("node <> leader").select("leader", "lo", "node").unionByName(size.where("k > 1").select("leader", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("lo"), F.col("leader").alias("node")))
    each = each.join(nodes, "node").select("leader", "lo", F.col("lo").alias("hi"), "node", "vec")
    met = stored(arrow_map(each.repartition(*KEY).sortWithinPartitions(*KEY), _to_leader(t), "leader long, node long, near boolean"), "op7-met")
    star = met.where("near and node <> leader").select(F.col("leader").alias("doc_a"), F.col("node").alias("doc_b"))
    far = met.where("not near")
    wide = far.groupBy("leader").agg(k).withColumnRenamed("k", "far_k").join(size, "leader")
    # far nodes by their blocks, each against every block of the group
    rows = large.drop("k", "lo").join(wide, "leader").withColumn("hi", block).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("far_k") - 1))).select("leader", "lo", "hi", "node", F.lit(False).alias("far"))
    some = far.select("leader", "node").join(wide, "leader").withColumn("lo", F.pmod(F.xxhash64("node"), "far_k").cast("int")).withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("leader", "lo", "hi", "node", F.lit(True).alias("far"))
    crossed = arrow_map(rows.unionByName(some).join(nodes, "node").repartition(*KEY).sortWithinPartitions(*KEY), _across(t), "doc_a long, doc_b long")
    return edges.unionByName(star).unionByName(crossed)


def deduplicated(vectors: DataFrame, t: float = T) -> DataFrame:
    """(vec_id, keep_id, kept) of every id: keep_id is the smallest id of its class of near vectors."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")).where("id is not null")
    usable = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    node = F.when((usable > 0) & (usable < float("inf")), F.xxhash64("vec"))
    own = stored(rows.withColumn("node", node).where("node is not null").groupBy("id", "node").agg(F.first("vec").alias("vec")), "op7-vectors")
    nodes = stored(own.groupBy("node").agg(F.first("vec").alias("vec")), "op7-nodes")
    # an id joins all nodes that it stands on
    of_id = own.select(F.col("node").alias("doc_a"), "id")
    several = of_id.groupBy("id").agg(F.min("doc_a").alias("least"), F.max("doc_a").alias("most")).where("least <> most").select("id", "least")
    same = of_id.join(several, "id").where("doc_a <> least").select(F.col("least").alias("doc_a"), F.col("doc_a").alias("doc_b"))
    found = components(_edges(nodes, t).unionByName(same))
    rooted = stored(own.select("id", "node").join(found, own["node"] == found["doc"], "left").select("id", F.coalesce("root", "node").alias("root")).distinct(), "op7-roots")
    least = rooted.groupBy("root").agg(F.min("id").alias("keep_id"))
    ids = rows.select(F.col("id").alias("vec_id")).distinct()
    out = ids.join(rooted.join(least, "root").select(F.col("id").alias("vec_id"), "keep_id"), "vec_id", "left").select("vec_id", F.coalesce("keep_id", "vec_id").alias("keep_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("keep_id"))


def oracle(t: float = T) -> str:
    return f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null),
p as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {t}),
r(vec_id, root) as (select vec_id, vec_id from v union select p.b, r.root from r join p on p.a = r.vec_id)
select vec_id, min(root) as keep_id, vec_id = min(root) as kept from r group by vec_id"""
