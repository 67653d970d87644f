"""From raw documents to training tokens: five stages, each over all that its predecessor kept.

Null texts are empty: the quality stage rejects them with every other text of fewer than 20 words. Rows without a
doc_id pass the stages that link documents. Rows that repeat a doc_id count as one document there: all of them stay, or
all go. Very long texts go through whole. An empty table gives an empty one. Extra columns of documents are carried to
the last stage; there, those named ids, n_tokens, ids_sha256 or decoded_sha256 are replaced by its own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import bpe, decontaminate, neardup, pii, quality
from pixelmill.llm.shared import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the policy rejects."""
    return quality.judged(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of every group of near-duplicates."""
    dropped = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("_copy"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain an item of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts and recounts their characters."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, and decodes the ids as a check: the digest of the bytes is that of the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, carry=[c for c in docs.columns if c != "text"], digests=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", redaction),
    ("byte_bpe", tokens),
]

#: SQL can't express the random field, nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
