"""Candidates to register letters: blanks, repeats, parties, serial numbers."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import direction, party_code
from ..functions.refs import normalize_ref
from .ordering import rank_in_slices

CANDIDATE = ["package_id", "document_id", "candidate"]


class Merged(NamedTuple):
    fresh: DataFrame
    repeats: DataFrame


def _filled(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def is_blank() -> F.Column:
    """Nothing was read: no reference, date, subject or party."""
    filled = _filled("letter_ref") | _filled("dated") | _filled("subject")
    return ~(filled | _filled("from_text") | _filled("to_text"))


def split_blank(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates that are letters, blank ones whose fields stay without a letter)."""
    return candidates.where(~is_blank()), candidates.where(is_blank())


def sort_key() -> F.Column:
    """Serial order as one comparable value: undated and unnamed first, then document and page."""
    return F.struct(
        F.coalesce(F.unix_date("dated"), F.lit(-(2**31))).alias("day"),
        F.coalesce("letter_ref_normalized", F.lit("")).alias("ref"),
        "document_id", "page_from", "candidate",
    )


def merge_existing(candidates: DataFrame, letters: DataFrame) -> Merged:
    """Candidates whose reference the package already holds become reports, not letters.

    The holder is a current letter, voided ones included, or the first candidate in serial
    order. Both are minima per reference, so copies of one letter never gather in a task.
    """
    key = ["package_id", "letter_ref_normalized"]
    held = (
        letters.where("is_current")
        .groupBy("package_id", normalize_ref(F.col("letter_ref")).alias("letter_ref_normalized"))
        .agg(F.min_by("letter_id", "serial").alias("existing_letter_id"))
    )
    keyed = candidates.withColumn("_order", sort_key())
    first = (
        keyed.where("letter_ref_normalized IS NOT NULL").groupBy(*key).agg(F.min("_order").alias("_first"))
    )
    judged = keyed.join(held, key, "left").join(first, key, "left")
    later = F.coalesce(F.col("_order") > F.col("_first"), F.lit(False))
    repeat = F.col("existing_letter_id").isNotNull() | later
    repeats = judged.where(repeat).select(
        *CANDIDATE, "letter_ref", "letter_ref_normalized", "existing_letter_id",
        F.when(F.col("existing_letter_id").isNull(), F.col("_first.document_id")).alias("first_document_id"),
    )
    return Merged(judged.where(~repeat).drop("_order", "_first", "existing_letter_id"), repeats)


def resolve_parties(candidates: DataFrame, parties: DataFrame) -> DataFrame:
    """Party codes and direction; `parties` (package_id, short_code) has three rows a package."""
    codes = parties.groupBy("package_id").agg(F.collect_set("short_code").alias("_codes"))
    return (
        candidates.join(codes, "package_id", "left")
        .withColumn("_codes", F.coalesce("_codes", F.array().cast("array<string>")))
        .withColumn("from_code", party_code(F.col("from_text"), F.col("_codes")))
        .withColumn("to_code", party_code(F.col("to_text"), F.col("_codes")))
        .withColumn("direction", direction(F.col("from_code"), F.col("to_code")))
        .drop("_codes")
    )


def assign_serials(candidates: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with serials, packages with advanced counters).

    `packages` has (package_id, next_serial). The order contains text, so positions come from
    range-partitioned slices: one package may hold most of a batch.
    """
    ranked = rank_in_slices(
        candidates.withColumn("_order", sort_key()), ["package_id"], [F.col("_order")], "_position"
    )
    numbered = (
        ranked.join(packages.select("package_id", "next_serial"), "package_id")
        .withColumn("serial", F.col("next_serial") + F.col("_position") - 1)
        .drop("_order", "_position", "next_serial")
    )
    used = candidates.groupBy("package_id").agg(F.count("*").alias("used"))
    advanced = packages.join(used, "package_id", "left").select(
        "package_id", (F.col("next_serial") + F.coalesce("used", F.lit(0))).alias("next_serial")
    )
    return numbered, advanced


def ref_collisions(letters: DataFrame) -> DataFrame:
    """Current letters sharing a reference within their package."""
    keyed = letters.where("is_current AND letter_ref IS NOT NULL").withColumn(
        "letter_ref_normalized", normalize_ref(F.col("letter_ref"))
    )
    key = ["package_id", "letter_ref_normalized"]
    shared = keyed.groupBy(*key).agg(F.count("*").alias("sharing")).where("sharing > 1")
    return keyed.join(shared, key).select(*key, "letter_id", "serial", "sharing")
