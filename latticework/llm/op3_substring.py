"""Repeated passages: every stretch of at least L words that also stands in another document.

1. Anchors.  The six residues of COVER form a difference cover modulo 31: for
   any two positions i and j some shift d < 31 puts both i + d and j + d on the
   cover.  Windows of 20 words are hashed at cover positions only (0.19 a
   word), and two equal passages of 50 = 20 + 31 - 1 words or more always have
   an aligned anchor in common.
2. Texts with the same words collapse to the smallest id.  An anchor that
   stands in two different texts is a hit.
3. Extension.  Around its hits a document hashes each window of exactly L
   words that holds one.  Windows are shuffled in runs, keyed by the smallest
   anchor-length hash inside them, so equal windows meet and a run is one row.
   A window found in two documents is a repeat; overlapping and adjoining
   repeats of a document merge into maximal passages.

No sampling of candidates and no cap on occurrences; a passage shared by any
number of documents costs one row for each run in each document.

Defined results: null ids or texts and texts of fewer than L words give no
rows; repeats inside one document alone are not reported; a row repeated with
the same id is one document; a text equal in its words to another one is
repeated from character 0 to its end; source is the smallest (doc_id, word)
that holds the first window of the passage; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WORD, _shared_hash, arrow_map, columns, in_chunks, lowered, mix, prefix_hash, runs, stored, windows, word_hashes

PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
L = 50
ANCHOR = L - PERIOD + 1
_on_cover = np.isin(np.arange(PERIOD), COVER)


def _content(prefix: np.ndarray) -> int:
    return int(mix(prefix[-1:] + U64(len(prefix)))[0].astype(np.int64))


def _anchors(batches):
    """Anchor rows (hash, content, word, -1) and one row (content, doc_id, -words, characters) a document."""
    schema = pa.schema([("h", pa.int64()), ("ref", pa.int64()), ("pos", pa.int32()), ("chars", pa.int32())])
    for b in batches:
        out = [[], [], [], []]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = word_hashes(text)
            if len(w) < L:
                continue
            p = prefix_hash(w)
            content = _content(p)
            at = np.flatnonzero(np.resize(_on_cover, len(w) - ANCHOR + 1))
            h = windows(p, ANCHOR, at)
            out[0].append(np.r_[h.view(np.int64), content])
            out[1].append(np.r_[np.full(len(h), content, np.int64), doc])
            out[2].append(np.r_[at, -len(w)].astype(np.int32))
            out[3].append(np.r_[np.full(len(h), -1, np.int32), np.int32(len(text))].astype(np.int32))
        if out[0]:
            yield from in_chunks([np.concatenate(x) for x in out], schema.names, schema)


def _hits(batches):
    """(content, word, 0, 0) of anchors that stand in two texts; (content, doc_id, first doc_id, words, chars) of texts."""
    schema = pa.schema([("content", pa.int64()), ("pos", pa.int32()), ("doc", pa.int64()), ("first", pa.int64()), ("n_words", pa.int32()), ("chars", pa.int32())])
    h, ref, pos, chars = columns(batches, ["h", "ref", "pos", "chars"])
    text = pos < 0
    o = np.lexsort((ref[text], h[text]))
    content, doc, n, c = (x[text][o] for x in (h, ref, pos, chars))
    if len(content):
        start, count = runs(content)
        none = np.full(len(doc), -1, np.int32)
        yield from in_chunks([content, none, doc, np.repeat(doc[start], count), -n, c], schema.names, schema)
    h, ref, pos = h[~text], ref[~text], pos[~text]
    o = np.argsort(h)
    h, ref, pos = h[o], ref[o], pos[o]
    if len(h):
        start, count = runs(h)
        many = np.repeat(np.minimum.reduceat(ref, start) != np.maximum.reduceat(ref, start), count)
        ref, pos = ref[many], pos[many]
        zero = np.zeros(len(ref), np.int64)
        yield from in_chunks([ref, pos, zero, zero, zero, zero], schema.names, schema)


def _candidates(batches):
    """Runs of L-word windows around a document's hits: (key, doc, first word, window hashes, character bounds)."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("s", pa.int32()), ("h", pa.binary()), ("ends", pa.binary())])
    for b in batches:
        out = [[], [], [], [], []]
        for doc, content, text, hits in zip(*(b.column(n).to_pylist() for n in ("doc", "content", "text", "hits"))):
            spans, words = [], []
            for m in WORD.finditer(lowered(text)):
                words.append(m.group())
                spans.append(m.span())
            p = prefix_hash(_shared_hash.array(words))
            if len(words) < L or _content(p) != content:
                continue
            starts = len(words) - L + 1
            near = np.zeros(starts + 1, np.int32)
            at = np.asarray(hits)
            np.add.at(near, np.clip(at - (L - ANCHOR), 0, starts), 1)
            np.add.at(near, np.clip(at + 1, 0, starts), -1)
            s = np.flatnonzero(near.cumsum()[:starts] > 0)
            if not len(s):
                continue
            inner = windows(p, ANCHOR)
            key = np.lib.stride_tricks.sliding_window_view(inner, L - ANCHOR + 1).min(axis=1)[s]
            h = windows(p, L, s)
            bounds = np.asarray(spans, np.int32)
            ends = np.stack([bounds[s, 0], bounds[s + L - 1, 1]], axis=1)
            cut = np.flatnonzero(np.r_[True, (s[1:] != s[:-1] + 1) | (key[1:] != key[:-1]), True])
            for i, j in zip(cut[:-1], cut[1:]):
                for o, x in zip(out, (key[i].astype(np.int64), doc, s[i], h[i:j].tobytes(), ends[i:j].tobytes())):
                    o.append(x)
        if out[0]:
            yield from in_chunks(out, schema.names, schema)


def _repeats(batches):
    """Maximal runs of windows that stand in two documents: (doc, words from and to, characters from and to, source)."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "s", "e", "cs", "ce", "source_doc", "source_word")])
    doc, s, h, ends = [], [], [], []
    for b in batches:
        for d, i, x, e in zip(*(b.column(n).to_pylist() for n in ("doc", "s", "h", "ends"))):
            hs = np.frombuffer(x, U64)
            h.append(hs)
            doc.append(np.full(len(hs), d, np.int64))
            s.append(np.arange(i, i + len(hs), dtype=np.int64))
            ends.append(np.frombuffer(e, np.int32).reshape(-1, 2))
    if not h:
        return
    doc, s, h, ends = map(np.concatenate, (doc, s, h, ends))
    o = np.lexsort((s, doc, h))
    doc, s, h, ends = doc[o], s[o], h[o], ends[o]
    start, count = runs(h)
    many = np.repeat(doc[start] != doc[start + count - 1], count)
    src = np.repeat(start, count)[many]
    source_doc, source_word = doc[src], s[src]
    doc, s, ends = doc[many], s[many], ends[many]
    o = np.lexsort((s, doc))
    doc, s, ends, source_doc, source_word = doc[o], s[o], ends[o], source_doc[o], source_word[o]
    if len(doc):
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (s[1:] != s[:-1] + 1)])
        last = np.r_[first[1:], len(doc)] - 1
        yield from in_chunks([doc[first], s[first], s[last] + L, ends[first, 0], ends[last, 1], source_doc[first], source_word[first]], schema.names, schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, start_char, end_char, source_doc, source_word): ends are exclusive."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null")
    anchors = arrow_map(rows, _anchors, "h long, ref long, pos int, chars int")
    found = stored(arrow_map(anchors.repartition("h"), _hits, "content long, pos int, doc long, first long, n_words int, chars int"), "op3-hits")
    hits = found.where("pos >= 0").groupBy("content").agg(F.collect_set("pos").alias("hits"))
    texts = found.where("pos < 0").select("content", "doc", "first", "n_words", "chars").distinct()
    wanted = hits.join(texts.where("doc = first").select("content", "doc"), "content")
    near = arrow_map(rows.join(wanted, "doc").select("doc", "content", "text", "hits"), _candidates, "key long, doc long, s int, h binary, ends binary")
    part = arrow_map(near.repartition("key"), _repeats, "doc long, s long, e long, cs long, ce long, source_doc long, source_word long")
    shared = texts.groupBy("content").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most")
    whole = texts.join(shared, "content").selectExpr("doc", "0L as s", "cast(n_words as long) as e", "0L as cs", "cast(chars as long) as ce", "first as source_doc", "0L as source_word")
    each = part.unionByName(whole)
    by = Window.partitionBy("doc").orderBy("s", F.desc("e"), "cs")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("opens", F.when(before >= F.col("s"), 0).otherwise(1)).withColumn("passage", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.struct("s", (-F.col("e")).alias("e"), "source_doc", "source_word")
    out = each.groupBy("doc", "passage").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min("cs").alias("start_char"), F.max("ce").alias("end_char"), F.min(first).alias("f"))
    return out.selectExpr("doc as doc_id", "start_word", "end_word", "start_char", "end_char", "f.source_doc as source_doc", "f.source_word as source_word")


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with each passage cut from the text wherever it isn't its own source; n_chars follows."""
    gone = passages.where("doc_id <> source_doc").groupBy(F.col("doc_id").alias("_lw_doc")).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("_lw_cut"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda acc, c: F.struct(c["end_char"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (c["start_char"] - acc["at"]).cast("int"))).alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text")))
    joined = docs.join(gone, docs["doc_id"].cast("long") == gone["_lw_doc"], "left")
    text = F.when(F.col("_lw_cut").isNull(), F.col("text")).otherwise(F.aggregate("_lw_cut", start, step, rest))
    out = joined.withColumn("_lw_text", text)
    return out.select(*[F.col("_lw_text").alias("text") if c == "text" else F.length("_lw_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns])


def oracle() -> str:
    return f"""
with d as (select doc_id, length(text) as chars, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') as ws, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}_]+') as seps
           from documents where doc_id is not null and text is not null),
t as (select doc_id, len(ws) as n, unnest(ws) as word, unnest(seps[1:len(ws)]) as sep, unnest(range(len(ws))) as pos from d where len(ws) >= {L}),
c as (select doc_id, n, pos, lower(word) as word, sum(length(word) + length(sep)) over (partition by doc_id order by pos) as ce, length(word) as len from t),
w as (select doc_id, n, pos, ce - len as cs, lead(ce, {L - 1}) over win as we, string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and {L - 1} following) as win_text
      from c window win as (partition by doc_id order by pos)),
g as (select *, min(doc_id) over (partition by win_text) as d0, max(doc_id) over (partition by win_text) as d1,
             first(doc_id) over (partition by win_text order by doc_id, pos) as source_doc, first(pos) over (partition by win_text order by doc_id, pos) as source_word from w where pos + {L} <= n),
whole as (select doc_id, chars, len(ws) as n, min(doc_id) over (partition by list_transform(ws, lambda x: lower(x))) as d0, max(doc_id) over (partition by list_transform(ws, lambda x: lower(x))) as d1 from d where len(ws) >= {L}),
same as (select doc_id from whole where d0 <> d1),
r as (select doc_id, pos as s, pos + {L} as e, cs, we as ce, source_doc, source_word from g where d0 <> d1 and doc_id not in (select doc_id from same)
      union all select doc_id, 0, n, 0, chars, d0, 0 from whole where d0 <> d1),
o as (select *, case when max(e) over (partition by doc_id order by s rows between unbounded preceding and 1 preceding) >= s then 0 else 1 end as opens from r),
p as (select *, sum(opens) over (partition by doc_id order by s) as passage from o)
select doc_id, min(s)::bigint as start_word, max(e)::bigint as end_word, min(cs)::bigint as start_char, max(ce)::bigint as end_char,
       arg_min(source_doc, s)::bigint as source_doc, arg_min(source_word, s)::bigint as source_word from p group by doc_id, passage"""
