"""Quality of documents: random-indexing word vectors, pooled, then a two-layer network with calibrated probabilities.

1. Every token (word or run of signs, case kept) has a fixed sparse index
   vector of +1 and -1, drawn from its hash; its word vector is the sum of the
   index vectors of its neighbours up to REACH tokens away, over all
   documents, scaled to length 1.  There is a vector for each distinct token.
2. A document pools its tokens' vectors: their mean, their mean weighted
   against frequent tokens, the lengths of both, the mean product of adjacent
   vectors, and the share of tokens equal to the one before.
3. A network of two layers (numpy, Adam) learns quality from at most
   TRAIN_ROWS labelled documents, those of lowest hash; a quarter of them is
   held out to find the temperature by which the logits are divided.

The table of word vectors is never in one place.  Documents are taken in
blocks; a block sends the counts and context sums of its own tokens, once each,
to the part that its hash names, and the part answers with the sums over all
blocks for the tokens that other blocks have too.  The answers meet the block's
token codes, and the block pools its documents.  A frequent token costs a row
a block, a document of any length stays whole.

Word vectors, counts and the labelling itself cover every document in full.

Defined results: a null, empty or blank text pools to zeros and gets the
probability that the network gives to that; a null id is kept; a repeated row
is scored again; of a document's several labels the lowest counts, null ones
never; with fewer than MIN_ROWS labelled documents, or labels of one kind, every
probability is (good + 1) / (labelled + 2); tokens are told apart by 64 bits of
hash; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, mix, runs, stored

DIM, REACH, NONZERO = 32, 2, 4
TRAIN_ROWS, MIN_ROWS = 4_000, 20
HIDDEN, EPOCHS, RATE, DECAY = 32, 120, 0.01, 1e-4
#: Share of a token among all that halves its weight; characters that stand for a token when shares are told.
SIF, TOKEN_CHARS = 1e-3, 5.0
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Characters of a block.
BLOCK, STEP = 32_000_000, 1 << 16
WIDTH = DIM + 1  # the last column takes what lies beyond a document's ends
FEATURES = 2 * DIM + 5


def index_places(hashes: np.ndarray) -> np.ndarray:
    """Columns of the non-zero elements of tokens' index vectors, by 24 bits of their hashes: the first half +1, the others -1."""
    left = np.tile(np.arange(DIM, dtype=np.int32), (len(hashes), 1))
    h, rows = mix((hashes.astype(U64) >> U64(40)) + U64(1)), np.arange(len(hashes))
    for k in range(NONZERO):  # the first steps of a shuffle
        other = k + ((h >> U64(12 * k)) % U64(DIM - k)).astype(np.int64)
        left[rows, k], left[rows, other] = left[rows, other], left[rows, k].copy()
    return np.ascontiguousarray(left[:, :NONZERO])


def contexts(parts: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(count, sums of the neighbours' index vectors) of each token; parts hold places in hashes."""
    n = len(hashes)
    places = np.concatenate([index_places(hashes), np.full((1, NONZERO), DIM, np.int32)])
    plus, count = np.zeros((n + 1) * WIDTH, np.int32), np.zeros(n + 1, np.int64)
    gap = np.full(REACH, n, np.int64)
    held: list[np.ndarray] = []

    def add():
        w = np.concatenate(held)
        count[:] += np.bincount(w, minlength=n + 1)
        row = w * WIDTH
        for away in range(1, REACH + 1):
            for at, other in ((row[:-away], w[away:]), (row[away:], w[:-away])):
                for k in range(NONZERO):
                    np.add.at(plus, at + places[other, k], np.int32(1 if k < NONZERO // 2 else -1))
        held.clear()

    size = 0
    for p in parts:
        held += [p, gap]
        size += len(p)
        if size > 2_000_000:
            add()
            size = 0
    if held:
        add()
    return count[:n], plus.reshape(-1, WIDTH)[:n, :DIM]


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers, signs in the lowest bit, in as few bytes as they need, equal bytes of all together."""
    x = x.astype(np.int64)
    x = ((x << 1) ^ (x >> 63)).view(U64)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, U64) if not x.size or x.max() <= np.iinfo(k).max)
    size = np.dtype(kind).itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, size).T)
    return bytes([size]) + zstandard.ZstdCompressor(1).compress(planes.tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    size = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(size, -1)
    x = np.ascontiguousarray(planes.T).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: U64}[size]).ravel().astype(U64)
    return (x >> U64(1)).view(np.int64) ^ -(x & U64(1)).view(np.int64)


class Block:
    """Documents of a task whose tokens are numbered in the order of (part, hash)."""

    def __init__(self, texts: list[str | None], n_parts: int):
        code: dict[str, int] = defaultdict()
        code.default_factory = code.__len__
        flat = [np.fromiter(map(code.__getitem__, found), np.int64, len(found)) for found in (TOKEN.findall(t) if t else () for t in texts)]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in code), U64, len(code))
        self.part = (hashes % U64(n_parts)).astype(np.int64)
        order = np.lexsort((hashes, self.part))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.parts = [place[x] for x in flat]
        self.hashes, self.part = hashes[order], self.part[order]
        #: By content, so it doesn't depend on the task; blocks of the same tokens share it, and get the same answers.
        self.number = int(np.uint64(xxhash.xxh3_64_intdigest(self.hashes.tobytes())).astype(np.int64))


ROW = "block long, part int, a binary, b binary, c binary"
_row = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _blocks(batches):
    """(ids, texts) of this task's blocks."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text or "")
            if size >= BLOCK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _asked(n_parts: int):
    """What blocks know of their own tokens: a row a part."""

    def run(batches):
        for _, texts in _blocks(batches):
            block = Block(texts, n_parts)
            count, sums = contexts(block.parts, block.hashes)
            start, many = runs(block.part)
            rows = [(block.number, int(block.part[s]), block.hashes[s : s + n].tobytes(), _pack(count[s : s + n]), _pack(sums[s : s + n].ravel())) for s, n in zip(start.tolist(), many.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _row)] if rows else [pa.array([], f.type) for f in _row], schema=_row)

    return run


def _answers(batches):
    """For each block, the counts and sums of those of its tokens that other blocks have too."""
    by: dict[int, list] = {}
    for b in batches:
        for block, part, a, c, s in zip(*(b.column(i).to_pylist() for i in range(5))):
            by.setdefault(part, []).append((block, np.frombuffer(a, U64), _unpack(c), s))
    for part, rows in by.items():
        known, place, often = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True, return_counts=True)
        count, sums, at = np.zeros(len(known), np.int64), np.zeros((len(known), DIM), np.int64), 0
        for _, h, c, s in rows:
            own = place[at : at + len(h)]
            at += len(h)
            count[own] += c
            sums[own] += _unpack(s).reshape(-1, DIM)
        at, out = 0, []
        for block, h, _, _ in rows:
            own = place[at : at + len(h)]
            at += len(h)
            shared = np.flatnonzero(often[own] > 1)
            if len(shared):
                out.append((block, part, _pack(np.diff(shared, prepend=0)), _pack(count[own[shared]]), _pack(sums[own[shared]].ravel())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _row)], schema=_row)


def _coded(n_parts: int):
    """Blocks themselves: ids, sizes and codes, and of the tokens' hashes what draws their index vectors."""

    def run(batches):
        for ids, texts in _blocks(batches):
            block = Block(texts, n_parts)
            null = np.array([i is None for i in ids])
            a = b"".join((len(ids).to_bytes(8, "little"), np.array([i or 0 for i in ids], np.int64).tobytes(), null.tobytes(), np.array([len(p) for p in block.parts], np.int64).tobytes()))
            often = np.argsort(-np.bincount(np.concatenate(block.parts), minlength=len(block.hashes)), kind="stable")  # frequent tokens get small numbers
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            codes = _pack(rank[np.concatenate(block.parts)])
            rest = _pack(often)
            many = np.bincount(block.part, minlength=n_parts)
            c = len(rest).to_bytes(8, "little") + rest + many.tobytes() + block.hashes.view(np.uint8).reshape(-1, 8)[:, 5:].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block.number, -1, a, codes, c), _row)], schema=_row)

    return run


def _features(n_parts: int, chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.binary())])

    def run(batches):
        whole: list[tuple] = []
        answers: dict[int, dict] = {}
        for b in batches:
            for block, part, *rest in zip(*(b.column(i).to_pylist() for i in range(5))):
                if part < 0:
                    whole.append((block, *rest))
                else:
                    answers.setdefault(block, {})[part] = rest
        if answers.keys() - {x[0] for x in whole}:
            raise RuntimeError("documents came in other partitions when they were read again")
        while whole:
            block, a, b, c = whole.pop()
            n = int.from_bytes(a[:8], "little")
            ids, null, size = np.frombuffer(a, np.int64, n, 8), np.frombuffer(a, bool, n, 8 + 8 * n), np.frombuffer(a, np.int64, n, 8 + 9 * n)
            k = int.from_bytes(c[:8], "little")
            often, first = _unpack(c[8 : 8 + k]), np.cumsum(np.frombuffer(c, np.int64, n_parts, 8 + k))
            hashes = np.zeros((len(often), 8), np.uint8)
            hashes[:, 5:] = np.frombuffer(c, np.uint8, offset=8 + k + 8 * n_parts).reshape(-1, 3)
            hashes = hashes.view(U64).ravel()
            codes = np.split(often[_unpack(b)] if len(often) else np.zeros(0, np.int64), np.cumsum(size)[:-1])
            count, sums = contexts(codes, hashes)
            for p, (at, own, total) in answers.get(block, {}).items():
                at = (first[p - 1] if p else 0) + np.cumsum(_unpack(at))
                count[at], sums[at] = _unpack(own), _unpack(total).reshape(-1, DIM)
            x = pooled(codes, *unit_vectors(count, sums, chars)).astype(np.float32)
            for i in range(0, n, 2000):
                j = min(n, i + 2000)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j], mask=null[i:j]), pa.array([r.tobytes() for r in x[i:j]], pa.binary())], schema=schema)

    return run


def unit_vectors(count: np.ndarray, sums: np.ndarray, chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of tokens from their counts and context sums, in a corpus of so many characters."""
    v = sums.astype(np.float32)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    return v, (SIF / (SIF + count * TOKEN_CHARS / max(1, chars))).astype(np.float32)


def pooled(parts: list[np.ndarray], vectors: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """FEATURES numbers of each document, from its tokens' rows in vectors and weights."""
    n = len(parts)
    out = np.zeros((n, FEATURES))
    size = np.array([len(p) for p in parts], np.int64)
    if not size.sum():
        return out
    w = np.concatenate(parts)
    doc = np.repeat(np.arange(n), size)
    near, mass = np.zeros(n), np.zeros(n)
    for i in range(0, len(w), STEP):  # a piece at a time, however long a document is
        x, d = w[i : i + STEP + 1], doc[i : i + STEP + 1]
        v = vectors[x]
        inside = min(STEP, len(w) - i)
        start = np.flatnonzero(np.r_[True, d[1:inside] != d[: inside - 1]])
        g = weights[x[:inside]]
        out[d[start], :DIM] += np.add.reduceat(v[:inside], start, axis=0)
        out[d[start], DIM : 2 * DIM] += np.add.reduceat(v[:inside] * g[:, None], start, axis=0)
        mass += np.bincount(d[:inside], weights=g, minlength=n)
        same = d[1:] == d[:-1]
        near += np.bincount(d[1:][same], weights=np.einsum("ij,ij->i", v[1:], v[:-1])[same], minlength=n)
        out[:, -1] += np.bincount(d[1:][same & (x[1:] == x[:-1])], minlength=n)
    some = np.maximum(size, 1)
    out[:, :DIM] /= some[:, None]
    out[:, DIM : 2 * DIM] /= np.maximum(mass, 1e-9)[:, None]
    out[:, 2 * DIM] = np.linalg.norm(out[:, :DIM], axis=1)
    out[:, 2 * DIM + 1] = np.linalg.norm(out[:, DIM : 2 * DIM], axis=1)
    out[:, 2 * DIM + 2] = near / np.maximum(size - 1, 1)
    out[:, 2 * DIM + 3] = np.log1p(size)
    out[:, 2 * DIM + 4] /= np.maximum(size - 1, 1)
    return out


class Network:
    """Standardised input, one hidden layer of tanh, one logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 0):
        self.constant = None
        n = len(y)
        if n < MIN_ROWS or len(set(y.tolist())) < 2:
            self.constant = (float(y.sum()) + 1) / (n + 2)
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        held, fit = order[: n // 4], order[n // 4 :]
        self.mean, self.std = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
        k = x.shape[1]
        self.p = [rng.normal(0, k**-0.5, (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        z = (x - self.mean) / self.std
        for _ in range(EPOCHS):
            turn = rng.permutation(fit)
            for i in range(0, len(fit), 128):
                at = turn[i : i + 128]
                a, target = z[at], y[at]
                h = np.tanh(a @ self.p[0] + self.p[1])
                e = (_sigmoid(h @ self.p[2] + self.p[3]) - target) / len(at)
                back = np.outer(e, self.p[2]) * (1 - h * h)
                grads = [a.T @ back + DECAY * self.p[0], back.sum(axis=0), h.T @ e + DECAY * self.p[2], np.array([e.sum()])]
                t += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    self.p[j] = self.p[j] - RATE * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        logits = self.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(10), 200))
        loss = [np.mean(np.logaddexp(0, logits / g) - y[held] * logits / g) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.std) @ self.p[0] + self.p[1])
        return (h * self.p[2]).sum(axis=1) + self.p[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, features) of every document: FEATURES floats as bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = arrow_map(arrow_map(rows, _asked(n_parts), ROW).repartitionById(n_parts, F.col("part")), _answers, ROW)
    both = answers.unionByName(arrow_map(rows, _coded(n_parts), ROW))
    return arrow_map(both.repartition("block"), _features(n_parts, chars), "doc_id long, features binary")


def sample(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality) of at most rows labelled documents: those of lowest hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(features: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    chosen = stored(sample(labels, rows).toDF("_lw_id", "_lw_quality"), "op2-sample")
    own = features.join(F.broadcast(chosen), features["doc_id"] == F.col("_lw_id"))  # rows bounds its size
    # rows that repeat an id would let the sample outgrow its bound
    found = own.groupBy("doc_id").agg(F.min("features").alias("features"), F.min("_lw_quality").alias("quality"))
    got = sorted((r["doc_id"], bytes(r["features"]), r["quality"]) for r in found.collect())
    x = np.array([np.frombuffer(r[1], np.float32) for r in got], float).reshape(-1, FEATURES)
    return Network(x, np.array([float(r[2] > 0) for r in got]))


def scored(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, probability, quality) of every document: quality is 1 from a probability of 0.5 up."""
    features = stored(featured(docs), "op2-features")
    network = docs.sparkSession.sparkContext.broadcast(fit(features, labels, rows))
    schema = pa.schema([("doc_id", pa.int64()), ("probability", pa.float64()), ("quality", pa.int32())])

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, FEATURES)
            p = network.value.probabilities(x.astype(float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.floor(p * 1e6 + 0.5) / 1e6), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return arrow_map(features, run, "doc_id long, probability double, quality int")
