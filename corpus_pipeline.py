"""The corpus pipeline: toxicity, near copies, benchmark leaks, mixing, token records.

Every stage takes the documents its predecessor kept, is written as Parquet to the folder the cluster
shares, and read again. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldtally.llm import decontaminate, jaccard_join, mixing, token_records, toxicity
from fieldtally.llm.common import load, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models score below 0.5."""
    return toxicity.without_toxic(docs, load(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return jaccard_join.one_of_each_group(docs, k=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the mix, and their index as read back from the files."""
    index = token_records.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("leaks", drop_leaks), ("mix", mix_sources),
          ("token_records", write_tokens)]

# Not expressible in SQL (trained models, tokenizer); tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
