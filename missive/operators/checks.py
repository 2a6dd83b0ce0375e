"""Type checks, cross-field anomalies, review status and triage. Findings are rows, never rejections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import as_date, parse_chainage
from ..session import grown


def check_types(fields: DataFrame, packages: DataFrame, clause_list: DataFrame) -> DataFrame:
    """Values that do not have the form their key requires.

    `packages` (package_id, ref_pattern) and `clause_list` (package_id, clause).
    """
    live = fields.where("is_current AND letter_id IS NOT NULL")
    ref_shape = packages.select("package_id", "ref_pattern")
    listed = clause_list.select("package_id", F.col("clause").alias("value"), F.lit(True).alias("_listed"))
    key = F.col("field_key")
    finding = (
        F.when(key.isin("dated", "received") & as_date(F.col("value")).isNull(), "not a calendar date")
        .when((key == "chainage") & parse_chainage(F.col("value")).isNull(), "not a chainage")
        .when((key == "clause") & F.col("_listed").isNull(), "clause not in the package's list")
        .when(
            key.isin("letter_ref", "cited_ref")
            & F.col("ref_pattern").isNotNull()
            & ~F.regexp(F.col("value"), F.col("ref_pattern")),
            "reference does not match the package's pattern",
        )
    )
    return (
        live.join(ref_shape, "package_id", "left")
        .join(listed, ["package_id", "value"], "left")
        .withColumn("finding", finding)
        .where("finding IS NOT NULL")
        .select("package_id", "letter_id", "field_id", "field_key", "value", "finding")
    )


def flag_anomalies(letters: DataFrame, packages: DataFrame, citations: DataFrame) -> DataFrame:
    """Received before dated, dated outside the contract, citing a later letter."""
    live = letters.where("is_current AND NOT is_voided")
    key = ["package_id", "letter_id"]
    early = live.where("received < dated").select(*key, F.lit("received before dated").alias("anomaly"))
    outside = (
        live.join(grown(packages), "package_id")
        .where("dated < starts_on OR dated > ends_on")
        .select(*key, F.lit("dated outside the contract period").alias("anomaly"))
    )
    dates = live.select("package_id", "letter_id", "dated")
    later = (
        citations.where("resolution = 'resolved'")
        .join(grown(dates).toDF("package_id", "citing_letter_id", "citing_dated"), ["package_id", "citing_letter_id"])
        .join(grown(dates).toDF("package_id", "cited_letter_id", "cited_dated"), ["package_id", "cited_letter_id"])
        .where("cited_dated > citing_dated")
        .select(
            "package_id", F.col("citing_letter_id").alias("letter_id"),
            F.lit("cites a later letter").alias("anomaly"),
        )
    )
    return early.unionByName(outside).unionByName(later)


def review_status(letters: DataFrame, fields: DataFrame, citations: DataFrame) -> DataFrame:
    """Status per letter from its current fields and its ambiguous citations."""
    per_letter = (
        fields.where("is_current AND letter_id IS NOT NULL")
        .groupBy("letter_id")
        .agg(
            F.bool_or(F.col("validation") == "unresolved").alias("unresolved"),
            F.bool_or(F.col("review_status") == "verified").alias("verified"),
        )
    )
    ambiguous = (
        citations.where("resolution = 'unresolved_ambiguous'")
        .select(F.col("citing_letter_id").alias("letter_id"), F.lit(True).alias("ambiguous"))
        .distinct()
    )
    return (
        letters.select("package_id", "letter_id")
        .join(grown(per_letter), "letter_id", "left")
        .join(grown(ambiguous), "letter_id", "left")
        .select(
            "package_id", "letter_id",
            F.when(F.col("unresolved") | F.col("ambiguous"), "needs_review")
            .when(F.col("verified"), "verified")
            .otherwise("unverified")
            .alias("review_status"),
        )
    )


def triage(fields: DataFrame) -> DataFrame:
    """Current fields per key and validation state."""
    states = ["exact", "normalized_exact", "unresolved", "human_corrected"]
    return (
        fields.where("is_current")
        .groupBy("package_id", "field_key")
        .agg(*[F.count_if(F.col("validation") == s).alias(s) for s in states])
    )


def unresolved_fields(fields: DataFrame) -> DataFrame:
    """What a reviewer works through: current fields that were not located."""
    return fields.where("is_current AND validation = 'unresolved'").select(
        "package_id", "document_id", "letter_id", "field_key", "field_index", "value", "verbatim"
    )
