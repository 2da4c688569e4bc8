"""A training-data pipeline over documents: each stage works on all that the one before it kept.

STAGES names the stages in order; run() applies them to the documents of a folder. Between stages the
documents are written to the shared folder and read again, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolattice.llm import bpe, decontaminate, importance, simhash, suffix_dedup
from aerolattice.llm.common import documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others are rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.resample(docs, labels).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8."""
    return simhash.representatives(docs.select(*COLUMNS), words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat 50 or more of an earlier one; those left empty go.

    A cut may part a character; its other bytes go with it.
    """
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), characters=True)
    left = cut.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.col("n_removed") == 0, F.col("columns.n_chars")).otherwise(F.length("kept")).alias("n_chars")
    return left.select("doc_id", F.col("kept").alias("text"), "columns.lang", "columns.source", n_chars)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_leaks(docs.select(*COLUMNS), items).where(F.size("leaks") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of what they decode to."""
    done = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return done.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_dedup),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("token ids", tokens),
]

#: No SQL: the first three stages are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
