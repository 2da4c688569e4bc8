"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, credentials, decontaminate, filter_audit, importance, oracles, quality_rules, severity, simhash, suffix_dedup, token_counts, token_files, url_filter
from .common import documents, fresh_path

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, public_tokenizers.path(WORD_BPE), limit=2048)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(documents(spark, sf_dir), words=4, radius=4, seed=42)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path(WORD_BPE), end_id=1)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and each benchmark item that it holds."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.inline("leaks")).withColumn("contaminated", F.lit(True))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    drawn = importance.scores(docs, labels(spark, sf_dir))
    return drawn.select("doc_id", F.round("log_weight", 4).alias("log_weight"), F.round("resampling_key", 4).alias("resampling_key"), "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = severity.train(docs, labels(spark, sf_dir))
    return severity.with_severity(docs, model).select("doc_id", "expected_severity", "grade", "toxic")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(BYTE_BPE))
    return done.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and hash of the base spans of each document, and all its spans."""
    found = credentials.with_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    counts = [credentials.count(F.col("spans"), kind).alias(f"n_{kind}") for kind in credentials.BASE_KINDS]
    base = credentials.joined(F.col("spans"), credentials.BASE_KINDS)
    return found.select("columns.doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), credentials.joined(F.col("spans")).alias("spans"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of each document under two tokenizers."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    return alignment.align(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)).select("columns.doc_id", *alignment.SUMS, "groups_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five text filters by source."""
    return filter_audit.audit_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_simhash, op3_token_files, op4_decontamination, op5_importance_resampling, op6_quality_rules, op7_suffix_dedup, op8_severity, op9_byte_bpe, op10_url_filter, op11_secret_scan, op12_token_alignment, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    """Tokenizers, components, removed spans and trained models are beyond SQL; tests hold these against brute force."""
    return {"op6_quality_rules": oracles.quality_rules(), "op13_filter_audit": oracles.filter_audit()}
