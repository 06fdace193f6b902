"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on. All but the last
return the columns of documents: documents without a recognised language go, one document of each
group of near copies stays, documents that hold a benchmark item go, secrets are masked in the text.
The last encodes the texts, and returns doc_id, n_tokens and the digests of the ids and of what they
decode to.

Defined cases, for every stage: a row is judged by its text alone; rows with equal or null ids are rows
of their own; other columns, whatever their names, come out as they went in; an empty table gives an
empty one with the same columns. Each stage says what null and empty texts come to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import byte_bpe, decontamination, language_id, secret_scan, simhash_dedup
from larkspur.llm.common import fresh_path
from larkspur.llm.queries import RANKS, secret_forest

#: The stages hold models and near-duplicate groups, which SQL does not express; tests compare them with brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the machines, trained on this table's own labels, tell. Null texts and texts without a letter go; without any labelled text all go."""
    return language_id.recognised(docs, language_id.trained(docs, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of fingerprints: one with the least id. Null, empty and word-less texts are copies of each other; equal ids with different texts both stay."""
    return simhash_dedup.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no item of the benchmark. Null and empty texts hold none, as do all if the benchmark is empty."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all rows and masks secrets in their texts. Null and empty texts stay as they are."""
    return secret_scan.redacted(docs, secret_forest(spark))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row, with doc_id, n_tokens and digests. Null and empty texts have no ids."""
    out = byte_bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secret_scan", mask_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
