"""A document read again: which letters are new versions, which are new, which need a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, grown
from .ordering import rank_in_slices
from .ranges import overlap_pairs

DOC = ["package_id", "document_id"]
CANDIDATE = [*DOC, "candidate"]


def _serial_list(serials: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_sort(serials).cast("array<string>"), ", "), F.lit("]"))


def _overlapping(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs with overlapping page ranges, each once; a range that ends before it begins overlaps nothing."""
    old = existing.select(
        *DOC, F.col("letter_id").alias("matched_id"), F.col("serial").alias("matched_serial"),
        F.col("page_from").alias("old_from"), F.col("page_to").alias("old_to"),
    )
    new = candidates.select(*CANDIDATE, "page_from", "page_to")
    pairs = overlap_pairs(new, old, DOC, ("page_from", "page_to"), ("old_from", "old_to"))
    return pairs.select(*CANDIDATE, "matched_id", "matched_serial")


def match_reprocessed(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Action per candidate: supersede, new, flag_ambiguous or flag_conflict, with the reason.

    `existing`: current letters (package_id, document_id, letter_id, serial,
    letter_ref_normalized, page_from, page_to). Only letters of the same document count.
    The serials a reason names belong to letters of one document.
    """
    by_ref = (
        existing.where("letter_ref_normalized IS NOT NULL")
        .groupBy(*DOC, "letter_ref_normalized")
        .agg(
            F.count("*").alias("ref_n"),
            F.min("letter_id").alias("ref_id"),
            F.min("serial").alias("ref_serial"),
            F.collect_list("serial").alias("ref_serials"),
        )
    )
    by_page = (
        _overlapping(existing, candidates)
        .groupBy(*CANDIDATE)
        .agg(
            F.count("*").alias("page_n"),
            F.min("matched_id").alias("page_id"),
            F.min("matched_serial").alias("page_serial"),
            F.collect_list("matched_serial").alias("page_serials"),
        )
    )
    ref_n, page_n = F.coalesce("ref_n", F.lit(0)), F.coalesce("page_n", F.lit(0))
    first = (
        F.when(ref_n == 1, "supersede").when(ref_n > 1, "flag_ambiguous")
        .when(page_n == 1, "supersede").when(page_n > 1, "flag_ambiguous").otherwise("new")
    )
    reason = (
        F.when(ref_n == 1, "same reference in the same document")
        .when(
            ref_n > 1,
            F.concat(
                F.lit("the reference is carried by "), ref_n.cast("string"),
                F.lit(" current letters, serials "), _serial_list(F.col("ref_serials")),
            ),
        )
        .when(
            page_n == 1,
            F.concat(
                F.lit("no reference match; page-range overlap with serial "),
                F.col("page_serial").cast("string"),
            ),
        )
        .when(
            page_n > 1,
            F.concat(
                F.lit("no reference match; page-range overlap with "), page_n.cast("string"),
                F.lit(" current letters, serials "), _serial_list(F.col("page_serials")),
            ),
        )
        .otherwise("no reference or page match")
    )
    matched = F.when(ref_n == 1, F.col("ref_id")).when((ref_n == 0) & (page_n == 1), F.col("page_id"))
    serial = F.when(ref_n == 1, F.col("ref_serial")).when(
        (ref_n == 0) & (page_n == 1), F.col("page_serial")
    )
    provisional = (
        candidates.join(grown(by_ref), [*DOC, "letter_ref_normalized"], "left")
        .join(grown(by_page), CANDIDATE, "left")
        .select(
            *CANDIDATE, "letter_ref_normalized", "page_from", "page_to",
            first.alias("action"), reason.alias("reason"),
            matched.alias("matched_id"), serial.alias("matched_serial"),
        )
    )
    claims = (
        provisional.where("action = 'supersede'").groupBy(*DOC, "matched_id").agg(F.count("*").alias("claims"))
    )
    contested = F.coalesce("claims", F.lit(0)) > 1
    conflict = F.concat(
        F.col("claims").cast("string"), F.lit(" candidates of this run match serial "),
        F.col("matched_serial").cast("string"),
    )
    return provisional.join(grown(claims), [*DOC, "matched_id"], "left").select(
        *CANDIDATE, "letter_ref_normalized", "page_from", "page_to",
        F.when(contested, "flag_conflict").otherwise(F.col("action")).alias("action"),
        F.when(~contested, F.col("matched_id")).alias("matched_id"),
        F.when(~contested, F.col("matched_serial")).alias("matched_serial"),
        F.when(contested, conflict).otherwise(F.col("reason")).alias("reason"),
    )


def apply_reprocessing(
    letters: DataFrame, matches: DataFrame, packages: DataFrame, actor: str = "reprocessing"
) -> tuple[DataFrame, DataFrame]:
    """(letters with the new versions, review events for flagged ones).

    New ids are derived from the candidate's own key, so a repeated run writes the same ids.
    Candidates that do not supersede get the package's next serials in document and candidate
    order; a superseding one keeps the serial of the letter it replaces.
    """
    matches = cut_lineage(matches)
    new_id = F.sha2(
        F.concat_ws("|", "package_id", "document_id", "candidate", F.lit("reprocessed")), 256
    )
    minted = matches.where("action <> 'supersede'")
    placed = rank_in_slices(
        minted.select(*CANDIDATE), ["package_id"], [F.col("document_id"), F.col("candidate")], "_position"
    )
    numbered = placed.join(grown(packages.select("package_id", "next_serial")), "package_id").select(
        *CANDIDATE, (F.col("next_serial") + F.col("_position") - 1).alias("fresh_serial")
    )
    versions = matches.join(grown(numbered), CANDIDATE, "left").select(
        new_id.alias("letter_id"),
        *DOC,
        F.coalesce("matched_serial", "fresh_serial").alias("serial"),
        "letter_ref_normalized", "page_from", "page_to",
        F.lit(True).alias("is_current"),
        F.lit(None).cast("string").alias("superseded_by"),
        F.when(F.col("action").startswith("flag"), "needs_review").otherwise("unverified").alias("review_status"),
        "action", "reason", "matched_id",
    )
    replaced = versions.where("matched_id IS NOT NULL").select(
        "package_id", F.col("matched_id").alias("letter_id"), F.col("letter_id").alias("_by")
    )
    columns = [
        "letter_id", *DOC, "serial", "letter_ref_normalized", "page_from", "page_to",
        "is_current", "superseded_by", "review_status",
    ]
    old = letters.join(grown(replaced), ["package_id", "letter_id"], "left").withColumns(
        {
            "is_current": F.col("is_current") & F.col("_by").isNull(),
            "superseded_by": F.coalesce("_by", "superseded_by"),
            "letter_id": F.col("letter_id").cast("string"),
        }
    )
    events = versions.where(F.col("action").startswith("flag")).select(
        "letter_id", F.lit(actor).alias("actor"), F.lit("flagged").alias("action"), F.col("reason").alias("note")
    )
    return old.select(*columns).unionByName(versions.select(*columns)), events
