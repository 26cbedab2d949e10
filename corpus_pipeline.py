"""A corpus from raw documents to tokens: unsafe texts out, passages and copies once, sources in proportion.

Every stage takes the documents its predecessor kept; ``run`` writes each
result to the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from obsgauge.llm import byte_bpe, line_chunks, mixture, near_copies, toxicity
from obsgauge.llm.common import table
from obsgauge.sources.shared import written

#: Learned weights, fuzzy hashes and merges have no SQL.
ORACLE_SQL = None

#: Texts that Spark and a Python task hand each other at once; both sides hold them all, and Spark's own number is 10,000.
BATCH_ROWS = 1000


def in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the toxicity threshold; the model learns from the labelled ones."""
    in_small_batches(spark)
    return toxicity.rejected(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur again, in the same document or another, stay at their first place only."""
    return line_chunks.cleaned(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard >= 0.8): the smallest id."""
    in_small_batches(spark)
    return near_copies.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document drawn twice is there twice."""
    return mixture.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    in_small_batches(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", safe), ("line dedup", passages_once), ("simhash near-dedup", one_of_each),
          ("mixture", mixed), ("byte bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
