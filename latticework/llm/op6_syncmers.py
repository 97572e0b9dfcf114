"""Document fingerprints by closed syncmers over words.

A window of k words is an anchor when the smallest hash among its inner
windows of s words stands at its first or last place.  Whether a window is
chosen depends on its own words alone, so the same passage gets the same
anchors in any document, and each run of k - s windows holds at least one.

Defined results: a null id or text, or a text without words, gives no row; a
text of fewer than k words gives one anchor at 0 over all its words; ties for
the smallest inner hash count wherever they stand; repeated rows repeat their
anchors; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, arrow_map, coefficients, window_hash, word_hashes

K, S = 16, 4
INNER_BASE = 0xD6E8FEB86659FD93


def syncmers(w: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 63-bit hashes of the anchors of a sequence of word hashes."""
    if not len(w):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    if len(w) < k:
        return np.zeros(1, np.int32), (window_hash(w, len(w)) >> U64(1)).astype(np.int64)
    inner = window_hash(w, s, base=INNER_BASE)
    span = k - s + 1
    low = np.lib.stride_tricks.sliding_window_view(inner, span).min(axis=1)
    first, last = inner[: len(low)], inner[span - 1 :]
    at = np.flatnonzero((first == low) | (last == low))
    return at.astype(np.int32), (window_hash(w, k, at) >> U64(1)).astype(np.int64)


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Rows (doc_id, pos, fingerprint): pos counts words from 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("fingerprint", pa.int64())])

    def run(batches):
        for b in batches:
            ids, at, fp = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, h = syncmers(word_hashes(text), k, s)
                ids.append(np.full(len(p), doc, np.int64))
                at.append(p)
                fp.append(h)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, at, fp)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    return arrow_map(rows, run, "doc_id long, pos int, fingerprint long")


def matches(anchors: DataFrame) -> DataFrame:
    """Positional matching: (doc_a < doc_b, offset = pos_b - pos_a, n) for each pair that shares anchors on a diagonal."""
    a = anchors.select(F.col("doc_id").alias("doc_a"), F.col("pos").alias("pos_a"), "fingerprint")
    b = anchors.select(F.col("doc_id").alias("doc_b"), F.col("pos").alias("pos_b"), "fingerprint")
    return a.join(b, "fingerprint").where("doc_a < doc_b").groupBy("doc_a", "doc_b", (F.col("pos_b") - F.col("pos_a")).alias("offset")).agg(F.count("*").alias("n"))


def _poly(names: list[str], base: int) -> str:
    return "(" + " + ".join(f"({n}::hugeint * {c}::hugeint) % 18446744073709551616" for n, c in zip(names, coefficients(len(names), base))) + ") % 18446744073709551616"


def oracle(k: int = K, s: int = S) -> str:
    outer = 0x9E3779B97F4A7C15
    short = " + ".join(f"coalesce((list_extract(hs, {j + 1})::hugeint * {c}::hugeint) % 18446744073709551616, 0)" for j, c in enumerate(coefficients(k - 1, outer)))
    ahead = lambda n: [f"lead(h, {j}) over w" for j in range(n)]
    return f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') as ws
           from documents where doc_id is not null and text is not null),
t as (select r, doc_id, len(ws) as n, unnest(ws) as word, unnest(range(len(ws))) as pos from d),
h as (select r, doc_id, n, pos, ('0x' || substr(md5(word), 1, 15))::bigint as h from t),
i as (select r, doc_id, n, pos, {_poly(ahead(s), INNER_BASE)} as inner_h,
             ({_poly(ahead(k), outer)}) // 2 as fp from h window w as (partition by r order by pos)),
l as (select *, min(inner_h) over (partition by r order by pos rows between current row and {k - s} following) as low,
             lead(inner_h, {k - s}) over (partition by r order by pos) as last_h from i)
select doc_id, pos::integer as pos, fp::bigint as fingerprint from l where pos + {k} <= n and (inner_h = low or last_h = low)
union all
select doc_id, 0 as pos, (({short}) % 18446744073709551616 // 2)::bigint as fingerprint
from (select r, doc_id, list(h order by pos) as hs from h where n < {k} group by all)"""
