"""Similar pairs within groups, counted once and never listed: shared by the operators that join by similarity.

Nodes that may be similar share a leader (a group's id).  A group of any size
is cut into tiles: its nodes fall into k salted blocks, k growing with the
group, and each two blocks form a tile, so that no task holds more than two
blocks and a hot group spreads over k * (k + 1) / 2 tasks.  A pair that shares
several leaders is looked at under the smallest only.

What leaves a tile is linear in its nodes: the number of links of each node
and the least node of the part that its links connect.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, columns, in_chunks, stored

#: Nodes, and units of their weight, of a block.
NODES, WEIGHT = 2048, 1 << 21
KEY = ("leader", "lo", "hi")


def groups(led: DataFrame) -> DataFrame:
    """(node, own): the leaders that each node shares with others, with the number of blocks, from distinct (node, leader, weight)."""
    size = led.groupBy("leader").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / NODES), F.ceil(F.col("w") / WEIGHT)).cast("int").alias("k")
    shared = led.select("node", "leader").join(size.select("leader", blocks), "leader")
    return shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("leader", "k"))).alias("own"))


def tiled(nodes: DataFrame) -> DataFrame:
    """A row for each tile of each node of (node, own, other columns), sorted by tile within partitions."""
    rest = [c for c in nodes.columns if c != "own"]
    each = nodes.select("*", F.explode("own").alias("_g"))
    each = each.select(*rest, F.col("_g.leader").alias("leader"), F.col("_g.k").alias("k"), F.transform(F.filter("own", lambda x: x["leader"] < F.col("_g.leader")), lambda x: x["leader"]).alias("before"))
    each = each.withColumn("side", F.pmod(F.xxhash64("node"), "k").cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    each = each.select("leader", F.least("side", "_j").alias("lo"), F.greatest("side", "_j").alias("hi"), "side", "before", *rest)
    return each.repartition(*KEY).sortWithinPartitions(*KEY)


def each_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tiles of at least two nodes, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in KEY], axis=1)
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for i, j in zip(cut[:-1], cut[1:]):
            now = tuple(keys[i].tolist())
            if now != last and held:
                if sum(h.num_rows for h in held) > 1:
                    yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(b.slice(i, j - i))
    if held and sum(h.num_rows for h in held) > 1:
        yield pa.Table.from_batches(held)


class Once:
    """Which pairs of a tile share no leader smaller than the tile's, and lie in different blocks where the tile has two."""

    def __init__(self, tile: pa.Table):
        lists = tile.combine_chunks().column("before").chunk(0)
        count = np.diff(lists.offsets.to_numpy())
        value = lists.flatten().to_numpy(zero_copy_only=False)
        side = tile.column("side").to_numpy()
        self.side = None if tile.column("lo")[0] == tile.column("hi")[0] else side
        self.bits = None
        if len(value):
            known, inverse, often = np.unique(value, return_inverse=True, return_counts=True)
            wanted = often > 1
            if wanted.any():
                place = np.cumsum(wanted) - 1
                hit = wanted[inverse]
                width = -(-int(wanted.sum()) // 64) * 64
                at = place[inverse][hit]
                self.bits = np.zeros((len(count), width // 64), U64)
                np.bitwise_or.at(self.bits, (np.repeat(np.arange(len(count)), count)[hit], at >> 6), U64(1) << (at & 63).astype(U64))

    def of(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that node i is to be compared with here."""
        if self.side is not None:
            others = others[self.side[others] != self.side[i]]
        if self.bits is not None and len(others):
            others = others[~(self.bits[others] & self.bits[i]).any(axis=1)]
        return others


class Links:
    """Links of a tile's nodes as they are found."""

    def __init__(self, node: np.ndarray):
        self.node, self.count, self.label = node, np.zeros(len(node), np.int64), np.arange(len(node))

    def add(self, i: int, others: np.ndarray):
        if not len(others):
            return
        self.count[i] += len(others)
        self.count[others] += 1
        seen = np.unique(np.r_[self.label[i], self.label[others]])
        for x in seen[1:]:
            self.label[self.label == x] = seen[0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, least node connected with it) of the nodes with links."""
        least = np.full(len(self.node), np.iinfo(np.int64).max)
        np.minimum.at(least, self.label, self.node)
        some = np.flatnonzero(self.count)
        return self.node[some], self.count[some], least[self.label[some]]


LINKS = "node long, links long, root long"
LINK_SCHEMA = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def classes(links: DataFrame) -> DataFrame:
    """(node, links, root) of every node with links: root is the least node of its connected component."""
    roots = components(links.select(F.col("node").alias("doc_a"), F.col("root").alias("doc_b")))
    total = links.groupBy("node").agg(F.sum("links").alias("links"))
    return total.join(roots, total["node"] == roots["doc"], "left").select("node", "links", F.coalesce("root", "node").alias("root"))


def _forest(batches):
    """A spanning star of each component that a partition's edges form: fewer edges to shuffle, the same components."""
    u, v = columns(batches, ["u", "v"])
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for a, b in zip(u.tolist(), v.tolist()):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    ends = [(x, root(x)) for x in list(parent)]
    ends = [(x, r) for x, r in ends if x != r]
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    if ends:
        yield from in_chunks([[x for x, _ in ends], [r for _, r in ends]], ["u", "v"], schema)


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(pairs: DataFrame) -> DataFrame:
    """(doc, root) of every document in a pair: root is the smallest id of its connected component.

    Alternates large-star and small-star steps until nothing changes; each round's edges are a stored table.
    """
    edges = pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct()
    edges = stored(arrow_map(edges, _forest, "u long, v long").distinct(), "components")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = small.groupBy("u").agg(F.min("v").alias("m"))
        joined = small.join(low, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = stored(out.where("u <> v").distinct(), "components")
        now = _state(after)
        edges = after
        if now == state:
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("doc"), F.col("v").alias("root")).distinct())
        state = now


#: Bits of a Bloom filter, and of one of its pieces.
BLOOM, BLOOM_PIECE = 1 << 25, 1 << 19


def _bloom_pieces(batches):
    own: dict[int, np.ndarray] = {}
    for b in batches:
        at = b.column(0).to_numpy(zero_copy_only=False)
        for p in np.unique(at // BLOOM_PIECE).tolist():
            bits = own.setdefault(p, np.zeros(BLOOM_PIECE, bool))
            bits[at[at // BLOOM_PIECE == p] % BLOOM_PIECE] = True
    schema = pa.schema([("piece", pa.int32()), ("bits", pa.binary())])
    for p, bits in own.items():
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], schema=schema)


class Bloom:
    """Which rows may be among given keys: BLOOM / 8 bytes on the driver and in the broadcast, whatever the input.

    Saves rows that are surely not among them a shuffle; where it is full it saves nothing, and changes nothing.
    """

    def __init__(self, keys: DataFrame, *on: str):
        self.on = on
        at = keys.select(F.pmod(F.xxhash64(*on), F.lit(BLOOM)).alias("at")).distinct().repartition((F.col("at") / BLOOM_PIECE).cast("int"))
        bits = np.zeros(BLOOM // 8, np.uint8)
        for piece, own in arrow_map(at, _bloom_pieces, "piece int, bits binary").collect():
            bits[piece * BLOOM_PIECE // 8 : (piece + 1) * BLOOM_PIECE // 8] = np.frombuffer(bytes(own), np.uint8)
        self.bits = keys.sparkSession.sparkContext.broadcast(bits)

    def rows(self, df: DataFrame, keys: list, inside: bool = True) -> DataFrame:
        """The rows of df that may be among the keys, or those that surely aren't (null keys among the latter)."""
        shared = self.bits
        some = keys[0].isNotNull()
        for k in keys[1:]:
            some = some & k.isNotNull()
        marked = df.select("*", F.when(some, F.pmod(F.xxhash64(*keys), F.lit(BLOOM))).alias("_lw_at"))

        def run(batches):
            for b in batches:
                last = b.num_columns - 1
                at = b.column(last)
                valid = at.is_valid().to_numpy(zero_copy_only=False)
                x = at.fill_null(0).to_numpy(zero_copy_only=False)
                hit = valid & ((shared.value[x >> 3] >> (x & 7).astype(np.uint8) & 1) == 1)
                yield b.select(list(range(last))).filter(pa.array(hit == inside))

        return arrow_map(marked, run, df.schema)
