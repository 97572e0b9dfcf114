"""Jaccard join, substring dedup, fingerprints, embeddings: against brute force, and odd inputs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import op3_substring as sub
from latticework.llm import op6_syncmers as syn
from latticework.llm import op7_embeddings as emb
from latticework.llm import op8_jaccard as jac
from latticework.llm import tiles
from latticework.llm.common import word_hashes

from .conftest import rows

WORD = re.compile(r"\w+")


def text(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    docs = [text(rng, rng.randrange(5, 200)) for _ in range(n)]
    for i in range(0, n, 4):  # near copies: some words changed
        w = docs[i].split()
        for _ in range(max(1, len(w) // 15)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(100)}"
        docs.append(" ".join(w))
    docs += [docs[0], docs[0].upper(), docs[1] + "."]
    return list(enumerate(docs))


def grams(t, n=3):
    w = WORD.findall(t.lower())
    return {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_pairs(docs, t=0.5):
    sets, out = {}, set()
    for i, x in docs:
        if x is None or i is None or not WORD.findall(x):
            continue
        sets.setdefault(frozenset(grams(x)), []).append(i)
    reps = [(min(v), k) for k, v in sets.items()]
    for v in sets.values():
        out |= {(min(v), x, 1.0) for x in set(v) if x != min(v)}
    for a, x in reps:
        for b, y in reps:
            if a < b and (j := len(x & y) / len(x | y)) >= t:
                out.add((a, b, round(j, 6)))
    return out


def brute_classes(docs, t=0.5):
    """(doc_id, class_id, copies, links) of documents with words, an id with several sets in several rows."""
    named = {(i, frozenset(grams(x))) for i, x in docs if x is not None and i is not None and WORD.findall(x)}
    sets = {s for _, s in named}
    near = {s: [o for o in sets if o != s and len(s & o) / len(s | o) >= t] for s in sets}
    label, out = {}, []
    for s in sets:
        todo = [s] if s not in label else []
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = s
                todo += near[x]
    for i, s in named:
        out.append((i, min(j for j, o in named if label[o] == label[s]), sum(o == s for _, o in named) - 1, len(near[s])))
    out += {(i, i, 0, 0) for i, x in docs if i is not None and not (x and WORD.findall(x))}
    return sorted(out)


def classes(make, docs, **kw):
    return sorted(tuple(r) for r in jac.jaccard_classes(make(docs, **kw)).collect())


def test_jaccard_equals_brute_force(make):
    docs = corpus()
    assert classes(make, docs) == brute_classes(docs)


def borderline(rng, n):
    """Pairs of texts whose similarity lies about the threshold."""
    docs = []
    for i in range(n):
        base = text(rng, rng.randrange(8, 80)).split()
        other = list(base)
        for _ in range(round(len(base) * rng.uniform(0.05, 0.2))):
            other[rng.randrange(len(other))] = f"q{rng.randrange(9)}"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other[: rng.randrange(len(other) // 2, len(other) + 1)]))]
    return docs


def test_jaccard_loses_no_pair_about_the_threshold(make):
    docs = borderline(random.Random(5), 1500)
    pairs = [len(grams(docs[i][1]) & grams(docs[i + 1][1])) / len(grams(docs[i][1]) | grams(docs[i + 1][1])) for i in range(0, len(docs), 2)]
    got = {r[0]: r for r in classes(make, docs)}
    for i, j in enumerate(pairs):
        if 0 < j < 1:
            assert (got[2 * i + 1][1] == 2 * i and got[2 * i][3] == 1) == (j >= 0.5), (i, j)
    assert sum(0.5 <= j <= 0.55 for j in pairs) > 30


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_jaccard_hot_group(make, monkeypatch, hot):
    """Copies and near copies of one text, in one tile and in many, with cold and with hot n-grams."""
    monkeypatch.setattr(jac, "HOT", hot)
    monkeypatch.setattr(tiles, "NODES", 8 if hot == 3 else 2048)
    rng = random.Random(3)
    base = text(rng, 60).split()
    docs = [(i, " ".join(base)) for i in range(40)]
    docs += [(100 + i, " ".join([*base[: -1 - i % 3], f"end{i}"])) for i in range(60)] + [(200 + i, x) for i, (_, x) in enumerate(corpus(4, 12))]
    assert classes(make, docs) == brute_classes(docs)


def test_jaccard_odd_inputs(make, spark):
    docs = [(1, None), (None, "a b c d"), (2, ""), (3, "!!! ..."), (4, "one"), (5, "ONE"), (6, "a b c d"), (6, "a b c d"), (7, "a b c d"), (8, "x " * 30_000)]
    assert classes(make, docs, extra=True) == brute_classes(docs)
    assert classes(make, []) == []


@pytest.mark.parametrize("turned", [False, True])
def test_jaccard_one_id_on_two_texts(make, turned):
    rng = random.Random(7)
    a, b = text(rng, 60), text(rng, 60)
    docs = [(1, a), (5, a + " tail"), (5, b)]
    docs = docs[::-1] if turned else docs
    assert classes(make, docs) == [(1, 1, 0, 1), (5, 1, 0, 1), (5, 5, 0, 0)]
    assert sorted((r.doc_id, r.text) for r in jac.keep_one(make(docs)).collect()) == [(1, a), (5, b)]


def test_wanted_texts_are_shuffled_however_few(spark):
    text = spark.range(1).selectExpr("id as doc", "id + 2 as hash", "'a b c d' as text")
    wanted = spark.range(1).selectExpr("id + 7 as node", "id as _lw_doc", "id + 2 as _lw_text")
    on = (F.col("doc") == F.col("_lw_doc")) & (F.col("hash") == F.col("_lw_text"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(text.join(wanted, on).select("node", "text"))
    got = jac.wanted_grams(text, wanted)
    assert "SortMergeJoin" in plan(got) and "Broadcast" not in plan(got)
    assert [(r.node, bytes(r.grams)) for r in got.collect()] == [(7, jac.ngrams("a b c d").tobytes())]


def test_keep_one_of_rows_equal_in_id_and_text(make):
    df = make([(1, "a b c d"), (2, "e f g h")]).unionByName(make([(1, "a b c d")], source="t"))
    kept = [sorted(map(tuple, jac.keep_one(x).collect())) for x in (df, df.orderBy("source"), df.orderBy("source", ascending=False))]
    assert kept[0] == kept[1] == kept[2] and [r[0] for r in kept[0]] == [1, 2]


def test_bitmap_bound_holds():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 60, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.r_[a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 60, rng.integers(1, 100), dtype=np.uint64)])
        x, y = jac.bitmap(a), jac.bitmap(b)
        width = min(len(x), len(y)) * 64
        apart = int(np.bitwise_count(jac.folded(x[None], width) ^ jac.folded(y[None], width)).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b))


def test_keep_one_keeps_the_least_of_each_connected_group(make):
    docs = [*corpus(9), (500, None), (None, "lone text"), (501, "")]
    kept = [r.doc_id for r in jac.keep_one(make(docs, extra=True)).collect()]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in brute_pairs(docs):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = sorted((i for i, _ in docs if i is None or find(i) == i), key=str)
    assert sorted(kept, key=str) == want


def test_components_of_a_long_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "doc_a long, doc_b long")
    got = dict(tiles.components(pairs).collect())
    assert set(got) == {*range(201), 1000, 1001} and all(got[i] == 0 for i in range(201)) and got[1001] == 1000


def brute_passages(docs, n=sub.L):
    where, words = {}, {}
    for d, t in docs:
        if d is None or t is None:
            continue
        words[d] = WORD.findall(t.lower())
        for i in range(len(words[d]) - n + 1):
            where.setdefault(tuple(words[d][i : i + n]), set()).add(d)
    out = set()
    for d, w in words.items():
        hit = sorted({j for i in range(len(w) - n + 1) if len(where[tuple(w[i : i + n])]) > 1 for j in range(i, i + n)})
        marks = [i for i in range(len(w) - n + 1) if len(where[tuple(w[i : i + n])]) > 1]
        start = None
        for k, i in enumerate(marks):
            if start is None:
                start = i
            if k + 1 == len(marks) or marks[k + 1] > i + n:
                out.add((d, start, i + n))
                start = None
        assert len(hit) == sum(e - s for x, s, e in out if x == d)
    return out


def test_substring_equals_brute_force(make):
    rng = random.Random(4)
    shared = [text(rng, k) for k in (50, 51, 80, 200, 49)]
    docs = []
    for i in range(30):
        parts = [text(rng, rng.randrange(0, 90), 50_000)]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), text(rng, rng.randrange(1, 40), 50_000)]
        docs.append((i, " ".join(parts)))
    docs.append((30, docs[3][1]))
    found = sub.repeated_passages(make(docs)).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in found} == brute_passages(docs)
    texts = dict(docs)
    for r in found:
        cut = texts[r.doc_id][r.start_char : r.end_char]
        assert len(WORD.findall(cut)) == r.end_word - r.start_word
        at = WORD.findall(texts[r.source_doc])
        assert at[r.source_word : r.source_word + sub.L] == WORD.findall(cut)[: sub.L]


def test_substring_edges(make):
    rng = random.Random(8)
    p = text(rng, 60)
    docs = [(1, None), (None, p), (2, ""), (3, p), (4, "x " + p + " y"), (5, text(rng, 49)), (6, p + " " + p), (7, "z " * 40_000)]
    got = {(r.doc_id, r.start_word, r.end_word) for r in sub.repeated_passages(make(docs, extra=True)).collect()}
    assert got == {(3, 0, 60), (4, 1, 61), (6, 0, 120)}
    assert rows(sub.repeated_passages(make([]))) == []
    assert rows(sub.repeated_passages(make([(3, p), (3, p)]))) == []  # one document, twice


def test_without_repeats_cuts_all_but_the_source(make):
    rng = random.Random(2)
    p = text(rng, 70)
    docs = make([(1, "head " + p + " tail"), (2, "before " + p + " after")])
    out = {r.doc_id: r for r in sub.without_repeats(docs, sub.repeated_passages(docs)).collect()}
    assert out[1].text == "head " + p + " tail" and out[2].text == "before  after" and out[2].n_chars == len(out[2].text)


def test_difference_cover_meets_every_pair_of_offsets():
    cover = set(sub.COVER)
    assert all(any((i + d) % sub.PERIOD in cover and (j + d) % sub.PERIOD in cover for d in range(sub.PERIOD)) for i in range(sub.PERIOD) for j in range(sub.PERIOD))


def test_syncmers_are_closed_and_context_free(make):
    rng = random.Random(6)
    p = text(rng, 100)
    a, b = (word_hashes(x + " " + p + " " + y) for x, y in (("one two", "q"), (text(rng, 33), "")))
    fa, fb = (dict(zip(h.tolist(), at.tolist())) for at, h in (syn.syncmers(a), syn.syncmers(b)))
    inside = [h for h, at in fa.items() if 2 <= at <= 2 + 100 - syn.K]
    assert inside and all(fb[h] - fa[h] == 31 for h in inside)
    at = syn.syncmers(a)[0]
    assert max(np.diff(at)) <= syn.K - syn.S + 1
    got = syn.matches(syn.fingerprints(make([(1, "one two " + p), (2, "a " + p)]))).collect()
    assert [(r.doc_a, r.doc_b, r.offset) for r in got] == [(1, 2, -1)]


def test_syncmers_odd_inputs(make):
    got = rows(syn.fingerprints(make([(1, None), (None, "a b"), (2, ""), (3, "a b"), (3, "a b"), (4, "w " * 50_000)], extra=True)))
    assert [r[:2] for r in got if r[0] == 3] == [(3, 0), (3, 0)] and {r[0] for r in got} == {3, 4}
    assert rows(syn.fingerprints(make([]))) == []


def vectors(spark, found):
    return spark.createDataFrame(found, "vec_id long, embedding array<float>, label int")


def brute_keep(x, t=emb.T):
    """Index -> smallest index of its class, by all pairs."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near, root = unit @ unit.T >= t, np.full(len(x), -1)
    for i in range(len(x)):
        todo = [i] if root[i] < 0 else []
        while todo:
            j = todo.pop()
            if root[j] < 0:
                root[j] = i
                todo += np.flatnonzero(near[j] & (root < 0)).tolist()
    return root.tolist()


def kept_of(spark, x):
    found = [(i, [float(e) for e in v], 0) for i, v in enumerate(x)]
    return {r.vec_id: r.keep_id for r in emb.deduplicated(vectors(spark, found)).collect()}


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_equal_brute_force(spark, monkeypatch, block):
    """Small clusters, one of 80 and a chain; as whole groups, and as large groups in blocks."""
    monkeypatch.setattr(emb, "NODES", block)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 64))
    near = [b + rng.normal(size=64) * s for b in base[:75] for s in (0.15, 0.3)]
    cluster = rng.normal(size=64) + rng.normal(size=(80, 64)) * 0.3
    chain = rng.normal(size=64) + np.cumsum(rng.normal(size=(30, 64)) * 0.25, axis=0)
    x = np.vstack([base, *near, cluster, chain]).astype(np.float32).astype(float)
    x[10] = x[200]
    got, want = kept_of(spark, x), brute_keep(x)
    assert len(got) == len(x) and got[200] == 10
    assert all(want[i] == want[k] for i, k in got.items())  # no false class
    assert sum(got[i] == k for i, k in enumerate(want)) >= 0.98 * len(x)


def test_recall_of_pairs_at_the_threshold(spark):
    """Lone pairs of cosine 0.9 to 0.95: at least 0.97 are found."""
    rng = np.random.default_rng(11)
    x = []
    for c in rng.uniform(0.9, 0.95, 400):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        x += [a, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)]
    x = np.array(x).astype(np.float32).astype(float)
    got, want = kept_of(spark, x), brute_keep(x)
    pairs = [i for i, k in enumerate(want) if i != k]
    assert len(pairs) > 380 and sum(got[i] == want[i] for i in pairs) >= 0.97 * len(pairs)


def test_embeddings_odd_inputs(spark):
    one = [1.0] + [0.0] * 7
    found = [(1, None, 0), (None, one, 0), (2, [], 0), (3, [0.0] * 8, 0), (4, [0.0] * 8, 0), (5, one, 0), (6, one, 0), (6, one, 0), (7, [1.0] + [0.0] * 3, 0), (8, [float("nan")] * 8, 0), (9, [None] * 8, 0)]
    found += [(20, [0.0, 1.0] + [0.0] * 6, 0), (21, [0.0, 1.0] + [0.0] * 6, 0), (21, [0.0, 0.0, 1.0] + [0.0] * 5, 0), (22, [0.0, 0.0, 1.0] + [0.0] * 5, 0)]  # 21 joins two
    kept = {r.vec_id: r.keep_id for r in emb.deduplicated(vectors(spark, found).selectExpr("*", "1 as id", "2 as key", "3 as home", "4 as node", "5 as leader")).collect()}
    assert kept == {i: i for i in range(1, 10)} | {6: 5} | {20: 20, 21: 20, 22: 20}
    assert emb.deduplicated(vectors(spark, [])).count() == 0


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(emb.hadamard(emb.hadamard(x)) / 16, x)


@pytest.mark.parametrize("d", [1, 2, 3, 64, 100])
def test_buckets_of_any_length(d):
    x = np.random.default_rng(d).normal(size=(4, d))
    home, also = emb.buckets(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert home.shape == (4, emb.TABLES) and also.shape == (4, emb.TABLES, emb.PROBES)
