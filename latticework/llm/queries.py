"""Queries of the training-data operators, each over the whole of its table, and their SQL."""

from __future__ import annotations

from . import op1_secrets, op2_quality, op3_substring, op4_language, op5_mixing, op6_syncmers, op7_embeddings, op8_jaccard, op9_bpe, op10_html
from .common import scan

QUERIES = {
    "op1_secret_scan": lambda spark, d: op1_secrets.findings(scan(d, "documents", spark)),
    "op2_quality": lambda spark, d: op2_quality.scored(scan(d, "documents", spark), scan(d, "labels", spark)),
    "op3_substring_dedup": lambda spark, d: op3_substring.repeated_passages(scan(d, "documents", spark)),
    "op4_language_id": lambda spark, d: op4_language.languages(scan(d, "documents", spark)),
    "op5_mixing": lambda spark, d: op5_mixing.mixed(scan(d, "documents", spark)),
    "op6_syncmers": lambda spark, d: op6_syncmers.fingerprints(scan(d, "documents", spark)),
    "op7_embedding_dedup": lambda spark, d: op7_embeddings.deduplicated(scan(d, "embeddings", spark)),
    "op8_jaccard_join": lambda spark, d: op8_jaccard.jaccard_classes(scan(d, "documents", spark)),
    "op9_bpe": lambda spark, d: op9_bpe.encoded(scan(d, "documents", spark)),
    "op10_html_content": lambda spark, d: op10_html.contents(scan(d, "pages", spark)),
}

SQL = {
    "op3_substring_dedup": op3_substring.oracle(),
    "op5_mixing": op5_mixing.oracle(),
    "op6_syncmers": op6_syncmers.oracle(),
    "op7_embedding_dedup": op7_embeddings.oracle(),
    "op8_jaccard_join": op8_jaccard.oracle(),
}
