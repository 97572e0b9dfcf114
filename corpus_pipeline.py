"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

1. language_id: documents of no known language, or of low confidence, go.
2. near_duplicates: of each connected group of similar documents the one with
   the smallest id stays.
3. secret_scan: secrets are masked in the text; every document stays.
4. mixing: documents are repeated or thinned to their source's share.
5. bpe: the rows that remain become tokens.

Defined results: documents with null ids or texts pass as the operators of
the stages define; an empty table gives an empty result; other columns of
documents are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import op1_secrets, op4_language, op5_mixing, op8_jaccard, op9_bpe
from latticework.llm.common import scan, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_language.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_jaccard.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_secrets.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op5_mixing.resample(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op9_bpe.encoded(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixing", mixing), ("bpe", bpe)]
#: Language scores and compression have no SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(sf_dir, "documents", spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
