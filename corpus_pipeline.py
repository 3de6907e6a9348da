"""A training-corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next
one's docs. All but the last return the columns of documents; the mix may return a document twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.llm import bpe, exact_dedup, langid, minhash, mixing
from moraine.llm.common import Stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was recognised."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the digests of ids and decoded text."""
    return bpe.digests(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("minhash_dedup", near), ("mixing", mix), ("bpe", encode)]

#: A classifier, connected components and a tokenizer are beyond SQL; tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage needs besides its result goes once that is written, and so do its docs."""
    stash = Stash(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for n, (name, stage) in enumerate(STAGES):
        mark = Stash.mark()
        docs = stash.put(stage(spark, docs, sf_dir), f"{n}_{name}")
        Stash.release(mark)
        if before:
            stash.drop(before)
        before = f"{n}_{name}"
    return docs
