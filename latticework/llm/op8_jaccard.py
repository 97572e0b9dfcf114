"""Documents whose word n-gram sets have Jaccard similarity >= t: classes, and the links of each document.

1. Each document becomes a set of hashed word n-grams; documents with equal
   sets are one node.  A hashed bitmap of the set has a width that follows its
   size band (a power of two).
2. Candidates, complete at t: n-grams are ordered from rare to frequent, by a
   counting sketch of fixed size over all documents, and two sets of
   similarity t share one among the first |x| - ceil(t |x|) + 1 of either.  If
   it is the first that they share and stands at place i of x, the overlap is
   |x| - i at most, which limits the sizes of partners.  The order decides how
   many candidates there are, never which pairs are found.  Sets that share
   such an n-gram and are linked by sizes within their limits get the smallest
   of them as leader, and that one's own smallest leader instead of it.
3. Tiles under a leader (see tiles.py): blocks of one size band meet the bands
   in reach.  The bits in which two bitmaps differ are at most the elements in
   which the sets differ, so popcount(xor) bounds the overlap from above; sets
   without a pair that could reach t go no further.
4. What is left is decided by intersecting the sorted arrays exactly, once for
   each pair.  Links are counted and connect classes; pairs are never listed.

An n-gram of more than HOT postings (by the sketch, or four times its mean) is
hot: its postings are spread by salt, and its leader is an aggregate, so no
task holds them all.  Other lists are shorter than that by the sketch's count.

Defined results: one row for each id and set; a null id gives no row; null
texts and texts without words are a class of their own with no links; a text of
fewer than n words has one n-gram, all its words; an id that stands on several
texts has a row for each of their sets; repeated rows count once; classes join
all documents that links and equal sets connect, and class_id is the smallest
id among them; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WORD, arrow_map, distinct, in_chunks, lowered, mix, pieces, runs, stored, window_hash, word_keys
from .tiles import KEY, Bloom, LINK_SCHEMA, LINKS, Links, Once, classes, components, each_tile, groups, tiled  # noqa: F401 (components is for op7)

N, T = 3, 0.5
BLOCK = 512
#: Cells of the sketch, and cells of one of its pieces; postings of an n-gram that make it hot; postings held before they are sent.
SKETCH, PIECE, HOT, HELD = 1 << 22, 1 << 16, 1 << 16, 1 << 19
SALT = 64


def ngrams(text: str, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text."""
    w = word_keys.array(WORD.findall(lowered(text)))
    if not len(w):
        return np.zeros(0, U64)
    return distinct(mix(window_hash(w, min(n, len(w)))))


def set_hash(grams: np.ndarray) -> int:
    """64 bits of a set: the same for equal sets only, but for accidents of a chance of n**2 / 2**64."""
    return int(mix(grams).sum(dtype=U64).astype(np.int64))


def width_of(size: int) -> int:
    """Bits of the bitmap of a set: the power of two in (2 x size, 4 x size], 64 at least."""
    return max(64, 1 << (2 * int(size)).bit_length())


def bitmap(grams: np.ndarray) -> np.ndarray:
    width = width_of(len(grams))
    bits = np.zeros(width, np.uint8)
    bits[(grams & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(U64)


def folded(maps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps OR-ed down to a smaller power of two."""
    while maps.shape[1] * 64 > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def _packed(counts: np.ndarray) -> bytes:
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if counts.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(1).compress(counts.astype(kind).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[blob[0]]
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), kind).astype(np.int64)


SIGNATURE = "doc_id long, text_hash long, node long, size int, bits binary, piece int, counts binary"


def _signatures(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("bits", pa.binary()), ("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sketch, seen = None, set()
        for b in pieces(batches):
            out = [[], [], [], [], []]
            for doc, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                g = ngrams(text, n)
                if not len(g):
                    continue
                node = set_hash(g)
                for o, x in zip(out, (doc, key, node, len(g), bitmap(g).tobytes())):
                    o.append(x)
                if node not in seen:
                    seen.add(node)
                    sketch = np.zeros(SKETCH, np.int64) if sketch is None else sketch
                    np.add.at(sketch, (g & U64(SKETCH - 1)).astype(np.int64), 1)
            none = len(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(o, f.type) for o, f in zip(out, schema)] + [pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], schema=schema)
        if sketch is not None:
            for i in range(0, SKETCH, PIECE):
                if sketch[i : i + PIECE].any():
                    row = [None, None, None, None, None, i // PIECE, _packed(sketch[i : i + PIECE])]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    return run


def signatures(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, text_hash, node, size, bits) of every document that has words, and the pieces of each task's sketch."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").where("doc_id is not null and text is not null")
    return arrow_map(rows, _signatures(n), SIGNATURE)


def level(count: np.ndarray) -> np.ndarray:
    """Counts as 8 bits: exact to 32, then in steps of 2 ** (1 / 8)."""
    return np.where(count <= 32, count, np.minimum(255, 32 + np.floor(8 * np.log2(np.maximum(count, 32) / 32)))).astype(np.uint8)


def _sum_pieces(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for piece, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = _unpacked(counts)
            total[piece] = total[piece] + x if piece in total else x
    schema = pa.schema([("piece", pa.int32()), ("levels", pa.binary()), ("n", pa.int64())])
    for piece, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([level(x).tobytes()], pa.binary()), pa.array([int(x.sum())], pa.int64())], schema=schema)


def order(sig: DataFrame) -> tuple[np.ndarray, int]:
    """(level of each cell of the sketch, lowest level that is hot): SKETCH bytes, whatever the input."""
    pieces = sig.where("piece is not null").select("piece", "counts").repartition("piece")
    levels, total = np.zeros(SKETCH, np.uint8), 0
    for piece, own, n in arrow_map(pieces, _sum_pieces, "piece int, levels binary, n long").collect():
        levels[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(bytes(own), np.uint8)
        total += n
    return levels, int(level(np.array([max(HOT, 4 * total // SKETCH)]))[0])


def prefix(grams: np.ndarray, levels: np.ndarray, t: float) -> np.ndarray:
    """The rarest n-grams, one of which any set of similarity t shares."""
    n = len(grams)
    rare = levels[(grams & U64(SKETCH - 1)).astype(np.int64)]
    return grams[np.argsort(rare, kind="stable")[: n - math.ceil(t * n - 1e-9) + 1]]


def largest(size: np.ndarray, place: np.ndarray, t: float) -> np.ndarray:
    """Size of the largest partner of similarity t of a set whose first shared n-gram stands at place / 256 of it."""
    return np.floor(size * ((1 - place / 256) * (1 + t) / t - 1) + 1e-6)


def _postings(t: float, n: int, parts: int, shared):
    """Cold postings of a task packed by part; hot ones a row each."""
    schema = pa.schema([("part", pa.int32()), ("packed", pa.binary()), ("gram", pa.int64()), ("node", pa.int64()), ("size", pa.int32())])

    def sent(held):
        first = np.concatenate([h[0] for h in held])
        doc = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        node, size = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.int32)
        place = np.concatenate([(np.arange(len(h)) * 256 // n).astype(np.uint8) for h, _, n in held])
        hot = shared.value[0][(first & U64(SKETCH - 1)).astype(np.int64)] >= shared.value[1]
        part = ((first >> U64(40)) % U64(parts)).astype(np.int32)
        if hot.any():
            spread = ((node[doc[hot]].view(U64) * U64(0x9E3779B97F4A7C15) >> U64(33)) % U64(parts)).astype(np.int32)
            k = len(spread)
            yield pa.RecordBatch.from_arrays([pa.array(spread), pa.nulls(k, pa.binary()), pa.array(first[hot].view(np.int64)), pa.array(node[doc[hot]]), pa.array(size[doc[hot]])], schema=schema)
            first, doc, place, part = first[~hot], doc[~hot], place[~hot], part[~hot]
        o = np.argsort(part, kind="stable")
        first, doc, place, part = first[o], doc[o], place[o], part[o]
        start, count = runs(part)
        rows = [[], []]
        for s, c in zip(start.tolist(), count.tolist()):
            at, many = runs(doc[s : s + c])
            own = doc[s + at]
            pieces = -(-many // 255)
            last = np.cumsum(pieces) - 1
            each = np.full(int(pieces.sum()), 255, np.uint8)
            each[last] = many - 255 * (pieces - 1)
            own = np.repeat(own, pieces)
            keys = np.ascontiguousarray(first[s : s + c]).view(np.uint8).reshape(-1, 8)[:, :5]
            rows[0].append(part[s])
            rows[1].append(b"".join((len(own).to_bytes(4, "little"), node[own].tobytes(), size[own].tobytes(), each.tobytes(), place[s : s + c].tobytes(), keys.tobytes())))
        k = len(rows[0])
        if k:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), *(pa.nulls(k, f.type) for f in list(schema)[2:])], schema=schema)

    def run(batches):
        held, many, seen = [], 0, set()
        for b in pieces(batches):
            for text in b.column(0).to_pylist():
                g = ngrams(text, n)
                if not len(g) or (node := set_hash(g)) in seen:
                    continue
                seen.add(node)
                first = prefix(g, shared.value[0], t)
                held.append((first, node, len(g)))
                many += len(first)
                if many > HELD:
                    yield from sent(held)
                    held, many = [], 0
        if held:
            yield from sent(held)

    return run


def _unpack_postings(blob: bytes):
    k = int.from_bytes(blob[:4], "little")
    node = np.frombuffer(blob, np.int64, k, 4)
    size = np.frombuffer(blob, np.int32, k, 4 + 8 * k)
    each = np.frombuffer(blob, np.uint8, k, 4 + 12 * k).astype(np.int64)
    n = int(each.sum())
    place = np.frombuffer(blob, np.uint8, n, 4 + 13 * k)
    key = np.zeros((n, 8), np.uint8)
    key[:, :5] = np.frombuffer(blob, np.uint8, 5 * n, 4 + 13 * k + n).reshape(n, 5)
    return key.view(U64).ravel(), np.repeat(node, each), np.repeat(size, each), place


def led_by(key, node, size, place, t: float):
    """(node, leader, size), distinct: leaders of the chains of sizes within their limits that share a key."""
    o = np.argsort(key)
    key, node, size, place = key[o], node[o], size[o], place[o]
    for again in (False, True):  # lone ones go, then those too small for all others, then lone ones again
        start, count = runs(key)
        keep = np.repeat(count > 1, count)
        if not again and len(start):
            keep &= largest(size, place, t) >= np.repeat(np.minimum.reduceat(size, start), count)
        key, node, size, place = key[keep], node[keep], size[keep], place[keep]
    o = np.lexsort((place, node, size, key))
    key, node, size, place = key[o], node[o], size[o], place[o]
    once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
    key, node, size, place = key[once], node[once], size[once], place[once]
    if not len(key):
        return key.astype(np.int64), node, size
    run = np.cumsum(np.r_[True, key[1:] != key[:-1]]) * float(1 << 32)
    reach = np.maximum.accumulate(run + largest(size, place, t))  # of all before, within a key
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (reach[:-1] < run[1:] + size[1:])])
    count = np.diff(np.r_[start, len(key)])
    leader = np.repeat(np.minimum.reduceat(node, start), count)
    keep = np.repeat(count > 1, count)
    node, leader, size = node[keep], leader[keep], size[keep]
    o = np.lexsort((leader, node))
    node, leader, size = node[o], leader[o], size[o]
    once = np.r_[True, (node[1:] != node[:-1]) | (leader[1:] != leader[:-1])] if len(node) else np.zeros(0, bool)
    return node[once], leader[once], size[once]


def _leaders(t: float):
    schema = pa.schema([("node", pa.int64()), ("leader", pa.int64()), ("weight", pa.int32()), ("gram", pa.int64())])

    def run(batches):
        found = [[], [], [], []]
        for b in batches:
            hot = b.column("gram").is_valid()
            own = b.filter(hot)
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("node"), pa.nulls(own.num_rows, pa.int64()), own.column("size"), own.column("gram")], schema=schema)
            for blob in b.column("packed").drop_null().to_pylist():
                for f, x in zip(found, _unpack_postings(blob)):
                    f.append(x)
        if found[0]:
            for b in in_chunks(list(led_by(*map(np.concatenate, found), t)), ["node", "leader", "weight"], pa.schema(list(schema)[:3])):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], schema=schema)

    return run


def candidates(docs: DataFrame, sig: DataFrame, t: float = T, n: int = N) -> DataFrame:
    """Distinct (node, leader, weight)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order(sig))  # SKETCH bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").where("doc_id is not null and text is not null")
    posts = arrow_map(rows, _postings(t, n, parts, shared), "part int, packed binary, gram long, node long, size int")
    found = stored(arrow_map(posts.repartitionById(parts, F.col("part")), _leaders(t), "node long, leader long, weight int, gram long"), "op8-leaders")
    cold = found.where("gram is null").select("node", "leader", "weight")
    hot = found.where("gram is not null").select("node", "weight", "gram", F.pmod(F.xxhash64("node"), F.lit(SALT)).alias("salt")).distinct()
    lead = hot.groupBy("gram", "salt").agg(F.min("node").alias("leader")).groupBy("gram").agg(F.min("leader").alias("leader"))
    lead = lead.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    warm = hot.join(lead, ["gram", "salt"]).select("node", "leader", "weight")
    led = stored(cold.unionByName(warm).distinct(), "op8-led")
    up = led.groupBy("node").agg(F.min("leader").alias("up")).withColumnRenamed("node", "leader")
    return stored(led.join(up, "leader").select("node", F.col("up").alias("leader"), "weight").distinct(), "op8-groups")


def in_reach(t: float, size: np.ndarray, maps: list[np.ndarray], once: Once):
    """(i, others) by rising size: pairs to be looked at here whose sizes and bitmaps allow similarity t."""
    by = np.argsort(size, kind="stable")
    width = np.array([len(m) for m in maps])
    blocks = []
    for w in np.unique(width):
        own = by[width[by] == w]
        blocks += [own[i : i + BLOCK] for i in range(0, len(own), BLOCK)]
    stacks = [np.stack([maps[i] for i in x]) for x in blocks]
    for n1, (x1, m1) in enumerate(zip(blocks, stacks)):
        for n2 in range(n1, len(blocks)):
            x2 = blocks[n2]
            if size[x1[-1]] < t * size[x2[0]]:
                continue
            m2 = folded(stacks[n2], m1.shape[1] * 64)
            for p, i in enumerate(x1):
                q = p + 1 if n1 == n2 else 0
                if q >= len(x2):
                    continue
                apart = np.bitwise_count(m2[q:] ^ m1[p]).sum(axis=1, dtype=np.int64)
                total = size[x2[q:]] + size[i]
                most = np.minimum((total - apart) // 2, np.minimum(size[x2[q:]], size[i]))
                some = once.of(i, x2[q:][most >= t * (total - most)])
                if len(some):
                    yield i, some


SURVIVOR = "leader long, lo int, hi int, side int, before array<long>, node long, size int"


def _bounded(t: float):
    """The nodes of each tile with a pair that its bitmaps allow."""

    def run(batches):
        for tile in each_tile(batches):
            size = tile.column("size").to_numpy().astype(np.int64)
            alive = np.zeros(len(size), bool)
            for i, some in in_reach(t, size, [np.frombuffer(x, U64) for x in tile.column("bits").to_pylist()], Once(tile)):
                alive[i] = alive[some] = True
            if alive.any():
                yield from tile.select(["leader", "lo", "hi", "side", "before", "node", "size"]).filter(pa.array(alive)).combine_chunks().to_batches()

    return run


def _exact(t: float):
    """Links of each tile by the intersection of the sorted arrays."""

    def run(batches):
        for tile in each_tile(batches):
            node = tile.column("node").to_numpy()
            _, first = np.unique(node, return_index=True)
            if len(first) < len(node):  # a document's row that is repeated
                tile = tile.take(pa.array(first))
                node = node[first]
            grams = [np.frombuffer(x, U64) for x in tile.column("grams").to_pylist()]
            size = np.array([len(g) for g in grams])
            union = np.unique(np.concatenate(grams))
            place = [np.searchsorted(union, g) for g in grams]
            mark = np.zeros(len(union), np.int32)
            links = Links(node)
            for i, some in in_reach(t, size, [bitmap(g) for g in grams], Once(tile)):
                mark[place[i]] = 1
                inter = np.add.reduceat(mark[np.concatenate([place[j] for j in some])], np.r_[0, np.cumsum(size[some])[:-1]])
                mark[place[i]] = 0
                links.add(i, some[inter / (size[some] + size[i] - inter) >= t])
            yield from in_chunks(list(links.rows()), LINK_SCHEMA.names, LINK_SCHEMA)

    return run


def _grams(n: int):
    schema = pa.schema([("node", pa.int64()), ("grams", pa.binary())])

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ngrams(x, n).tobytes() for x in b.column(1).to_pylist()], pa.binary())], schema=schema)

    return run


def wanted_grams(text: DataFrame, wanted: DataFrame, n: int = N) -> DataFrame:
    """(node, grams) of the wanted texts.

    The join shuffles, however small it is: text comes out of Python, and a broadcast would have both steps in one
    task, with two workers, which an executor then keeps and takes in turn.
    """
    met = text.join(wanted.hint("merge"), (F.col("doc") == F.col("_lw_doc")) & (F.col("hash") == F.col("_lw_text")))
    return arrow_map(met.select("node", "text"), _grams(n), "node long, grams binary")


def linked(docs: DataFrame, t: float = T, n: int = N) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, node) of documents with words, (node, links, root) of sets with links)."""
    sig = stored(signatures(docs, n), "op8-signatures")
    named = sig.where("node is not null")
    sets = named.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("size").alias("size"), F.first("bits").alias("bits"))
    members = groups(candidates(docs, sig, t, n)).join(sets.select("node", "size", "bits"), "node")
    alive = stored(arrow_map(tiled(members), _bounded(t), SURVIVOR), "op8-survivors")
    wanted = alive.select("node").distinct().join(sets.select("node", F.col("at.doc_id").alias("_lw_doc"), F.col("at.text_hash").alias("_lw_text")), "node")
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"), "text").where("doc is not null and text is not null")
    wanted = stored(wanted, "op8-wanted")
    text = Bloom(wanted, "_lw_doc", "_lw_text").rows(text, [F.col("doc"), F.col("hash")])
    grams = wanted_grams(text, wanted, n)
    each = alive.drop("size").join(grams, "node").repartition(*KEY).sortWithinPartitions(*KEY)
    links = stored(arrow_map(each.select("leader", "lo", "hi", "side", "before", "node", "grams"), _exact(t), LINKS), "op8-links")
    return named.select("doc_id", "text_hash", "node"), classes(links)


def jaccard_classes(docs: DataFrame, t: float = T, n: int = N) -> DataFrame:
    """(doc_id, class_id, copies, links): other documents of the same set, and other sets of similarity >= t."""
    named, found = linked(docs, t, n)
    own = named.select("doc_id", "node").distinct().join(found, "node", "left").select("doc_id", "node", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    own = stored(own, "op8-classes")
    least = own.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    size = own.groupBy("node").agg((F.count("*") - 1).alias("copies"))
    worded = own.join(least, "root").join(size, "node").select("doc_id", "class_id", "copies", "links")
    blank = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[\p{L}\p{N}_]"))
    return worded.unionByName(blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("links")).distinct())


def keep_one(docs: DataFrame, t: float = T, n: int = N) -> DataFrame:
    """docs without near copies: of each class the document with the smallest id stays, and of its texts the one of the smallest hash.

    Rows with a null id or a text without words are in no class and stay.  Of
    rows equal in id and text one stays: that of the smallest hash of its
    other columns (maps left out).
    """
    named, found = linked(docs, t, n)
    own = stored(named.join(found.select("node", "root"), "node", "left").groupBy("doc_id", "text_hash").agg(F.min(F.coalesce("root", "node")).alias("root"), F.count("*").alias("n")), "op8-rows")
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
    leads = (F.col("doc_id") == F.col("at.doc_id")) & (F.col("text_hash") == F.col("at.text_hash"))
    touched = own.join(first, "root").select(F.col("doc_id").alias("_lw_doc"), F.col("text_hash").alias("_lw_text"), leads.alias("_lw_leads"), "n").where("not _lw_leads or n > 1")
    touched = stored(touched, "op8-touched")
    bloom, cols = Bloom(touched, "_lw_doc", "_lw_text"), docs.columns
    key = [docs["doc_id"].cast("long"), F.xxhash64(docs["text"])]
    sure, rest = bloom.rows(docs, key, inside=False), bloom.rows(docs, key)
    same = lambda x: (rest["doc_id"].cast("long") == x["_lw_doc"]) & (F.xxhash64(rest["text"]) == x["_lw_text"])
    once = rest.join(touched, same(touched), "left_anti")
    plain = [c for c in cols if "map<" not in docs.schema[c].dataType.simpleString()]
    again = touched.where("_lw_leads")
    each = rest.join(again, same(again), "left_semi").select("doc_id", "text", F.struct(*cols).alias("_lw_row"), F.xxhash64(*plain).alias("_lw_h"))
    each = each.groupBy("doc_id", "text").agg(F.min_by("_lw_row", "_lw_h").alias("_lw_row"))
    return sure.unionByName(once).unionByName(each.select(*[F.col("_lw_row")[c].alias(c) for c in cols]))


def oracle(t: float = T, n: int = N) -> str:
    gram = " || ' ' || ".join(f"list_extract(ws, i + {j})" for j in range(n))
    return f"""
with recursive w as (select distinct doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as ws from documents where doc_id is not null and text is not null),
d as (select distinct doc_id, list_sort(list_distinct(case when len(ws) < {n} then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - {n - 2}), lambda i: {gram}) end)) as g from w where len(ws) > 0),
c as (select doc_id, min(doc_id) over (partition by g) as rep, count(*) over (partition by g) - 1 as copies, g from d),
e as (select rep, len(g) as n, unnest(g) as gram from (select distinct rep, g from c)),
p as (select x.rep as a, y.rep as b, x.n as na, y.n as nb, count(*) as k from e x join e y on x.gram = y.gram and x.rep <> y.rep group by all),
l as (select a, b from p where k / (na + nb - k)::double >= {t}),
r(rep, root) as (select distinct rep, rep from c union select l.b, r.root from r join l on l.a = r.rep),
m as (select rep, min(root) as class_id from r group by rep)
select c.doc_id, m.class_id, c.copies, (select count(*) from l where l.a = c.rep) as links from c join m using (rep)
union all
select distinct doc_id, doc_id as class_id, 0 as copies, 0 as links from documents where doc_id is not null and not regexp_matches(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]')"""
