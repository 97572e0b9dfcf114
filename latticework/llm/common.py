"""Shared plumbing of the training-data operators.

Documents travel as Arrow batches.  Operators that need all rows of a key in
one place repartition by that key and read their partition as numpy columns:
sorting 8-byte keys in numpy costs a small fraction of a JVM row sort, and the
size of a partition is governed by ``spark.sql.shuffle.partitions`` as usual.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from latticework.cluster import ship, stored  # noqa: F401 (stored is for the operators)

WORD = re.compile(r"\w+")
U64 = np.uint64
MASK64 = (1 << 64) - 1


def scan(sf_dir: str, table: str, spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


class WordHash(dict):
    """word -> 60-bit integer (first 15 hex digits of its MD5), memoised up to a fixed number of words."""

    limit = 250_000

    def __missing__(self, word: str) -> int:
        value = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


_shared_hash = WordHash()


class WordKey(WordHash):
    """word -> 64-bit integer by XXH3, which costs a fraction of MD5."""

    limit = 100_000

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.limit:
            self.clear()
        self[word] = value
        return value


word_keys = WordKey()


def lowered(text: str) -> str:
    """Lower case, character for character: the offsets of the text hold in the result."""
    t = text.lower()
    return t if len(t) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words (runs of letters, digits, underscore) of a text."""
    return _shared_hash.array(WORD.findall(lowered(text)))


def coefficients(n: int, base: int = 0x9E3779B97F4A7C15) -> list[int]:
    """base, base**2, ... base**n modulo 2**64 (base odd)."""
    out, c = [], 1
    for _ in range(n):
        c = c * base & MASK64
        out.append(c)
    return out


def window_hash(w: np.ndarray, n: int, at: np.ndarray | None = None, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """sum_j w[i+j] * base**(j+1) mod 2**64 for every window of n words (or the windows that start at ``at``)."""
    m = len(w) - n + 1
    if at is None:
        out = np.zeros(max(m, 0), U64)
        for j, c in enumerate(coefficients(n, base) if m > 0 else []):
            out += w[j : j + m] * U64(c)
    else:
        out = np.zeros(len(at), U64)
        for j, c in enumerate(coefficients(n, base)):
            out += w[at + j] * U64(c)
    return out


_power = np.ones(1, U64), np.ones(1, U64)
_BASE = 0x9E3779B97F4A7C15


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse, modulo 2**64, for i up to n at least."""
    global _power
    if len(_power[0]) <= n:
        size = max(4096, 1 << (n + 1).bit_length())
        with np.errstate(over="ignore"):
            _power = tuple(np.r_[U64(1), np.full(size - 1, b, U64)].cumprod(dtype=U64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _power


def prefix_hash(w: np.ndarray) -> np.ndarray:
    """p[i] = sum of w[t] * _BASE**t over t < i, for i = 0..len(w)."""
    up, _ = powers(len(w))
    return np.r_[U64(0), (w * up[: len(w)]).cumsum(dtype=U64)]


def windows(prefix: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Mixed hashes of the windows of n words, from prefix_hash: equal words, equal hash, at any position."""
    _, down = powers(len(prefix))
    if at is None:
        m = len(prefix) - n
        return mix((prefix[n:] - prefix[:m]) * down[:m]) if m > 0 else np.zeros(0, U64)
    return mix((prefix[at + n] - prefix[at]) * down[at])


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """All of a partition's rows as numpy columns (fixed-width, non-null)."""
    parts = [[] for _ in names]
    for b in batches:
        for p, n in zip(parts, names):
            p.append(b.column(n).to_numpy(zero_copy_only=False))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most so many rows: what a step makes of texts is held for a slice, not for a batch."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _given_back(fn):
    """fn, after which a worker that is kept for later tasks returns its free memory to the system."""

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass

    return run


def in_chunks(arrays: list, names: list[str], schema: pa.Schema, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    n = len(arrays[0])
    for i in range(0, n, size):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + size], schema.field(k).type) for a, k in zip(arrays, names)], schema=schema)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(_given_back(fn), schema)
