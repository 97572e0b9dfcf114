"""The pipeline against a version in plain Python, stage by stage."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from latticework.llm import op1_secrets, op4_language, op5_mixing, op9_bpe

from .test_content import brute_fill
from .test_dedup import brute_pairs


def plain(docs):
    """Rows of dictionaries -> Counter of (doc_id, tokens)."""
    chosen = [d for d in docs if d["lang"] is not None and d["text"] is not None and d["doc_id"] is not None]
    scores = op4_language._Scores(op4_language.Model(sorted((d["lang"], d["text"]) for d in chosen)))
    found = [(d, op4_language.identify(d["text"], scores)) for d in docs]
    docs = [d for d, f in found if f[0] != "und" and f[1] >= op4_language.MIN_CONFIDENCE]
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in brute_pairs([(d["doc_id"], d["text"]) for d in docs]):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    docs = [d for d in docs if find(d["doc_id"]) == d["doc_id"]]
    docs = [d | {"text": t, "n_chars": d["n_chars"] if t == d["text"] else len(t)} for d in docs for t in [op1_secrets.mask(d["text"])]]
    sizes = Counter()
    for d in docs:
        sizes["=" + d["source"]] += d["n_chars"]
    epochs = brute_fill(sizes, {k: v**op5_mixing.ALPHA for k, v in sizes.items() if v}, op5_mixing.MAX_EPOCHS, sum(sizes.values()))
    out, t = Counter(), op9_bpe.load()
    for d in docs:
        e = epochs.get("=" + d["source"], 0)
        u = int(hashlib.md5(f"{op5_mixing.SEED}:{d['doc_id']}".encode()).hexdigest()[:8], 16) / 2**32
        out[d["doc_id"], tuple(t.encode(d["text"]).tolist())] += int(e) + (u < e - int(e))
    return +out


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_run_equals_the_plain_version(spark, sf_dir, inputs):
    got = Counter((r.doc_id, tuple(r.tokens)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == plain([r.asDict() for r in inputs.collect()])


def test_stages_keep_the_columns_of_documents(spark, sf_dir, inputs):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, inputs, sf_dir).columns == inputs.columns, name


def test_odd_documents_pass_through_every_stage(spark, sf_dir, make):
    key = "9f8Xq2LmZ7vTr4KdWc1YbN6sPj3HgE5a"
    docs = make([(1, None), (None, "the house and the garden"), (2, ""), (3, f"token = {key} the house"), (3, f"token = {key} the house")], extra=True)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    docs.collect()
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
