"""From raw documents to token ids: quality, near-duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it kept or changed; what it returned is written and read again as the
next one's documents, so a stage reads its input as often as it needs and a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm import contamination, near_dups, pieces, quality, secret_scan
from missive.llm.common import shared_folder, table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; SimHash fingerprints link at four or fewer differing bits, found by ball hashing."""
    return near_dups.representatives(docs).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return contamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the text decoded from the ids."""
    found = pieces.round_trip(docs, MODEL)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "text")


STAGES = [
    ("quality classifier", judge_quality),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("secret scan", mask_secrets),
    ("SentencePiece", encode),
]

# the classifier's training and the tokenizer's merges are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
