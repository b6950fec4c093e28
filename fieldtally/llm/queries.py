"""Registered queries of the operators, one for each, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, embedding_dedup, hard_negatives, jaccard_join, line_dedup, mixing, oracles, quality,
               secret_scan, token_records, toxicity, vantage_search, whitening)
from .common import load


def op1_pigeonhole_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(load(spark, folder, "embeddings"))


def op2_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_spans(load(spark, folder, "documents"))


def op3_chat_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = load(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.read_back(chat_format.format_turns(rows))


def op4_weighted_fair_queue(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_token_records(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    index = token_records.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_adaptive_prefix_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.similar_groups(docs, k=3, num=90, den=100).drop("text_hash", "group")


def op7_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return toxicity.score(docs, load(spark, folder, "labels"))


def op8_deletion_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(load(spark, folder, "documents").select("doc_id", "text"))


def op9_compression(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return quality.score(docs, load(spark, folder, "labels"))


def op10_spaced_seeds(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, load(spark, folder, "benchmark")).drop("text_hash")


def op11_angular_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = load(spark, folder, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op12_vantage_trees(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "embeddings").select("vec_id", "embedding")
    return vantage_search.nearest_vectors(rows, F.col("vec_id") % 20 == 0)


def op13_feast_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(load(spark, folder, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (
    op1_pigeonhole_vectors, op2_secret_ownership, op3_chat_round_trip, op4_weighted_fair_queue, op5_token_records,
    op6_adaptive_prefix_join, op7_kneser_ney, op8_deletion_neighbours, op9_compression, op10_spaced_seeds,
    op11_angular_negatives, op12_vantage_trees, op13_feast_whitening)}
ORACLE = oracles.ORACLE
