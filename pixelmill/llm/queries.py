"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import bpe, decontaminate, langid, lattice, licenses, neardup, pii, quality, secrets, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.detect(_table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(_table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = langid.remainder(F.col("doc_id"), 5)
    models = langid.fit(docs.where(fold != 0))
    found = langid.identify(docs, models, carry=["doc_id"])
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, carry=["doc_id"], ids=False, digests=True)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.recognise(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(_table(spark, sf_dir, "pages"))
    return found.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_length").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.col("refers_page").cast("long").alias("refers_to"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


_ALL = (op1_secrets, op2_lm_scoring, op3_pii, op4_language_id, op5_byte_bpe, op6_minhash_near_dedup, op7_license_rules, op8_quality_rules, op9_warc, op10_decontamination)
QUERIES = {f.__name__: f for f in _ALL}
#: The others have no SQL form (trained models, BPE) and are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_minhash_near_dedup": neardup.ORACLE_SQL,
    "op7_license_rules": licenses.oracle_sql(),
    "op8_quality_rules": quality.oracle_sql(),
    "op9_warc": warc.ORACLE_SQL,
    "op10_decontamination": decontaminate.ORACLE_SQL,
}
