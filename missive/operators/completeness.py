"""Completeness figures and model usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENS = ["input_tokens", "output_tokens"]


def usage_drift(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Runs whose stored token totals differ from the sum over their requests."""
    summed = requests.groupBy("run_id").agg(*[F.sum(t).alias(f"summed_{t}") for t in TOKENS])
    differs = F.lit(False)
    for t in TOKENS:
        differs = differs | ~F.col(t).eqNullSafe(F.coalesce(f"summed_{t}", F.lit(0)))
    return (
        runs.join(summed, "run_id", "left")
        .where(differs)
        .select("run_id", *TOKENS, *[F.coalesce(f"summed_{t}", F.lit(0)).alias(f"summed_{t}") for t in TOKENS])
    )


def usage_totals(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Tokens per package and pipeline version, with subtotals."""
    per_run = requests.groupBy("run_id").agg(F.count("*").alias("requests"), *[F.sum(t).alias(t) for t in TOKENS])
    return (
        runs.select("run_id", "package_id", "pipeline_version")
        .join(per_run, "run_id")
        .rollup("package_id", "pipeline_version")
        .agg(
            F.sum("requests").alias("requests"), *[F.sum(t).alias(t) for t in TOKENS],
            F.grouping_id().alias("level"),
        )
    )


def completeness(
    packages: DataFrame, filings: DataFrame, runs: DataFrame, letters: DataFrame, missing: DataFrame
) -> DataFrame:
    """Per package: documents filed, read and failed, letters, letters to review, missing references."""
    key = "package_id"
    attempts = runs.groupBy(key, "document_id").agg(
        F.bool_or(F.col("is_current")).alias("ok"), F.bool_or(F.col("status") == "failed").alias("failed")
    )
    documents = (
        filings.join(attempts, [key, "document_id"], "left")
        .groupBy(key)
        .agg(
            F.count("*").alias("documents_filed"),
            F.count_if("ok").alias("documents_read"),
            F.count_if(F.col("failed") & ~F.col("ok")).alias("documents_failed"),
        )
    )
    live = (
        letters.where("is_current AND NOT is_voided")
        .groupBy(key)
        .agg(
            F.count("*").alias("letters"),
            F.count_if(F.col("review_status") == "needs_review").alias("needs_review"),
        )
    )
    absent = missing.groupBy(key).agg(F.count("*").alias("missing_references"))
    counts = ["documents_filed", "documents_read", "documents_failed", "letters", "needs_review", "missing_references"]
    return (
        packages.select(key)
        .join(documents, key, "left")
        .join(live, key, "left")
        .join(absent, key, "left")
        .select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    )
