"""The operators' queries. Each applies its operator, with production parameters, to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, decontamination, language_id, lm_scoring, quality_rules, secret_scan, sharding, simhash_dedup, token_counts, toxicity
from larkspur.llm.common import documents, remainder

PIECES, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.sharded(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_verdicts(documents(spark, sf_dir), labels(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language_id.trained(docs, F.coalesce(remainder(F.col("doc_id"), 3) != 1, F.lit(False)))
    out = language_id.identified(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.encoded(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_scoring.lm_scores(documents(spark, sf_dir), F.coalesce(remainder(F.col("doc_id"), 7) != 2, F.lit(True)))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.trained(docs, labels(spark, sf_dir), F.coalesce(remainder(F.col("doc_id"), 3) != 1, F.lit(False)))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "offending")


def secret_forest(spark: SparkSession) -> secret_scan.Forest:
    return secret_scan.trained(secret_scan.seed_findings(spark), words=secret_scan.vocabulary(public_tokenizers.path(RANKS)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(documents(spark, sf_dir), secret_forest(spark))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sharding, op3_decontamination, op4_quality_rules, op5_language_id, op6_byte_bpe, op7_simhash_dedup, op8_lm_scoring, op9_toxicity, op10_secret_scan)}
ORACLE_SQL: dict[str, str] = {}
