"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, lexicon, licenses, mixing, nn_descent, pii, quality, simhash, token_output
from .common import id_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_bucket("doc_id", 7) == 2
    scored = ctw.score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "source", "weight", "block", "slot", "position")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), id_bucket("doc_id", 5) == 0
    learned = lexicon.learn_from(docs, _table(spark, sf_dir, "labels"), "toxic", ~held_out)
    scored = lexicon.score_texts(docs.select("doc_id", "text"), learned)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_hits").alias("hits"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), id_bucket("doc_id", 3) == 1
    weights, bias = quality.learn_from(docs, _table(spark, sf_dir, "labels"), "quality", ~held_out)
    scored = quality.score_texts(docs.select("doc_id", "text"), weights, bias)
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "licence", F.round("dice", 6).alias("dice"), "n_units")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "score", "question_overlap", "answer_overlap", "first_word", "n_words")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, recall = nn_descent.near_duplicates(_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept", F.lit(recall).alias("audited_recall"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_output, op2_decontamination, op3_lm_scoring, op4_mixing, op5_toxicity, op6_simhash_near_dedup,
        op7_quality, op8_embedding_near_dedup, op9_pii, op10_licenses,
    )
}

#: DuckDB SQL for the queries that it can express.
ORACLE_SQL: dict[str, str] = {"op10_licenses": licenses.oracle_sql()}
