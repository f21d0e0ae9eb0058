"""A corpus pipeline: quality rules, near-duplicate removal, surrogates for personal data, mixing and tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.llm import bpe, mixing, pii, quality, shingle_join
from fragmill.llm.common import cut


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.representatives(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.checked(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and the hash of what the ids decode to."""
    import public_tokenizers

    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), *how)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality", good), ("near_duplicates", distinct), ("pii", private), ("mixing", mixed), ("bpe", tokens)]

#: SQL has no form of the tokenizer or the permutation; tests/llm/test_pipeline.py holds run() against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
