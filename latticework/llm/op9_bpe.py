"""Byte-level BPE: encoding, and decoding back to the same text.

A text splits into pre-tokens.  Tier one: a minimal perfect hash (hash and
displace: n keys, n slots, one displacement a bucket) tells whether the whole
pre-token is in the vocabulary, and its id.  Tier two, for misses: the bytes
form a linked list, a heap holds the mergeable neighbours by rank, and the
lowest rank merges until none is left, in O(n log n) for a pre-token of any
length; those of FEW bytes at most merge in the same order by a plain list,
which is faster there.  Answers are memoised for a bounded number of strings a
worker: of two generations of MEMO strings the older one is dropped when the
younger is full, so strings that come again stay, whatever came first.  Texts
are taken ROWS at a time.

The vocabulary is read once on the driver from a path that is a parameter and
is broadcast: its size is that of the file, whatever the data.

Defined results: a null text has null tokens and counts; an empty text has
none; ids may be null, tied or repeated, each row is encoded for itself; text
of any length is encoded whole; special tokens in a text are ordinary text;
other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, arrow_map, pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: No vocabulary of more bytes than this is broadcast.
LARGEST_VOCABULARY = 64_000_000
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: No pre-token crosses the border of these pieces.
_WS = "".join(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))  # the pattern's \s
PIECE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Strings of a generation of the memo; rows that are held as tokens at once; bytes of a pre-token that needs no heap.
MEMO, ROWS, FEW = 100_000, 256, 48
K1, K2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """bytes -> index of a fixed set of keys, by one displacement a bucket; any other key gives -1."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(set(hashes.tolist())) != n:
            raise ValueError("repeated keys")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        members = [order[starts[b] : starts[b + 1]] for b in range(self.buckets)]
        taken = np.zeros(n, bool)
        slots = np.zeros(n, np.int64)
        shift = [0] * self.buckets
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            m = members[b]
            if len(m) < 2:
                break
            base = 0
            while True:
                d = np.arange(base, base + 64, dtype=np.uint64)[:, None]
                at = ((((hashes[m] ^ (d * np.uint64(K1))) * np.uint64(K2)) >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                s = np.sort(at, axis=1)
                good = np.flatnonzero(~taken[at].any(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1))
                if len(good):
                    shift[b] = base + int(good[0])
                    taken[at[good[0]]] = True
                    slots[m] = at[good[0]]
                    break
                base += 64
        free = iter(np.flatnonzero(~taken).tolist())
        for b in range(self.buckets):  # a lone key takes any free slot, named outright
            if len(members[b]) == 1:
                at = next(free)
                shift[b] = -1 - at
                slots[members[b][0]] = at
        self.shift = shift
        self.key: list[bytes] = [b""] * n
        self.index = [0] * n
        for i, at in enumerate(slots.tolist()):
            self.key[at], self.index[at] = keys[i], i

    def get(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        at = (((h ^ (d * K1 & MASK64)) * K2 & MASK64) >> 32) % self.n if d >= 0 else -1 - d
        return self.index[at] if self.key[at] == key else -1


#: Pre-tokens of fewer bytes have heap keys of narrow positions.
SHORT = 1 << 24


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.ids = [ranks[k] for k in keys]
        self.bytes = {i: k for k, i in ranks.items()}
        self.pieces = _Memo(self._piece)

    def __reduce__(self):
        return Tokenizer._thaw, (self.ranks, self.hash)

    @staticmethod
    def _thaw(ranks, table):
        out = Tokenizer.__new__(Tokenizer)
        out.ranks, out.hash, out.ids = ranks, table, list(ranks.values())
        out.bytes = {i: k for k, i in ranks.items()}
        out.pieces = _Memo(out._piece)
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that isn't in the vocabulary."""
        return self._few(piece) if len(piece) <= FEW else self._many(piece)

    def _few(self, piece: bytes) -> list[int]:
        rank, never = self.ranks.get, 1 << 62
        at = list(range(len(piece) + 1))
        pair = [rank(piece[i : i + 2], never) for i in at[:-2]]
        while pair and (low := min(pair)) != never:
            i = pair.index(low)
            del pair[i], at[i + 1]
            if i < len(pair):
                pair[i] = rank(piece[at[i] : at[i + 2]], never)
            if i:
                pair[i - 1] = rank(piece[at[i - 1] : at[i + 1]], never)
        return [self.ranks[piece[i:j]] for i, j in zip(at, at[1:])]

    def _many(self, piece: bytes) -> list[int]:
        rank, n = self.ranks.get, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i ends; 0 once it is merged away
        before = list(range(-1, n))
        bits = 24 if n < SHORT else 48  # of a position or length in a heap key
        high, low = 2 * bits, (1 << bits) - 1
        heap = [r << high | i << bits | 2 for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            x = heappop(heap)
            i = x >> bits & low
            e = i + (x & low)
            j = end[i]
            if not j or j >= n or end[j] != e:
                continue
            end[i], end[j] = e, 0
            if e < n:
                before[e] = i
                k = end[e]
                if (r := rank(piece[i:k])) is not None:
                    heappush(heap, r << high | i << bits | k - i)
            p = before[i]
            if p >= 0 and (r := rank(piece[p:e])) is not None:
                heappush(heap, r << high | p << bits | e - p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _piece(self, piece: str) -> tuple[int, ...]:
        body = piece[1:] if piece[0] == " " else piece
        if not body.isalpha():
            if body[:-1].isalpha() and not body[-1].isnumeric() and body[-1] != " ":
                tokens = [piece[:-1], piece[-1]]
            else:
                tokens = PRETOKEN.findall(piece)
            if len(tokens) > 1:
                return tuple(chain.from_iterable(map(self.pieces.__getitem__, tokens)))
        raw = piece.encode()
        at = self.hash.get(raw)
        return (self.ids[at],) if at >= 0 else tuple(self.merge(raw))

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, PIECE.findall(text))), np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 100:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


@lru_cache(maxsize=4)
def load(path: str = VOCABULARY) -> Tokenizer:
    """A vocabulary of lines "base64 rank"."""
    with open(path, "rb") as f:
        raw = f.read(LARGEST_VOCABULARY + 1)
    if len(raw) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} has more than {LARGEST_VOCABULARY} bytes")
    return Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})


def _encoder(shared):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int32()), ("tokens", pa.list_(pa.int32())), ("exact", pa.bool_())])

    def run(batches):
        t = shared.value
        for b in pieces(batches, ROWS):
            ids, sizes, parts, exact, null = b.column(0), [], [], [], []
            for text in b.column(1).to_pylist():
                null.append(text is None)
                x = t.encode(text or "")
                parts.append(x)
                raw = (text or "").encode()
                sizes.append(None if text is None else len(raw))
                exact.append(None if text is None else t.decode(x.tolist()) == raw)
            count = np.array([len(p) for p in parts], np.int32)
            offsets = pa.array(np.r_[0, count.cumsum()].astype(np.int32), mask=np.r_[np.array(null, bool), False])
            lists = pa.ListArray.from_arrays(offsets, np.concatenate(parts) if parts else np.zeros(0, np.int32))
            counts = pa.array(count, mask=np.array(null, bool)) if len(count) else pa.array([], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), counts, lists, pa.array(exact, pa.bool_())], schema=schema)

    return run


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, tokens, exact): exact says that the tokens decode to the text's own bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, _encoder(shared), "doc_id long, n_bytes long, n_tokens int, tokens array<int>, exact boolean")


def decoded(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens).  Bytes that are no UTF-8 become U+FFFD; an unknown id is an error."""
    shared = tokens.sparkSession.sparkContext.broadcast(load(path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        for b in batches:
            texts = [None if x is None else shared.value.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return arrow_map(tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("tokens").cast("array<int>").alias("tokens")), run, "doc_id long, text string")
