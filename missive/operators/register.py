"""The register and the listings around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import DASH, display_value
from ..session import cut_lineage
from .ordering import latest_earlier_day

CITATION = ["package_id", "citing_letter_id", "cited_ref_normalized"]


def with_party_codes(letters: DataFrame, parties: DataFrame) -> DataFrame:
    """from_code and to_code by the package's own parties."""
    for side in ("from", "to"):
        codes = parties.select(
            "package_id", F.col("party_id").alias(f"{side}_party_id"), F.col("short_code").alias(f"{side}_code")
        )
        letters = letters.join(codes, ["package_id", f"{side}_party_id"], "left")
    return letters


def register(letters: DataFrame) -> DataFrame:
    """Live letters with the previous letter of their thread and the days since it.

    `letters` carries from_code, to_code and thread_key. The previous letter is the last one of
    the nearest strictly earlier day, the highest serial of that day.
    """
    live = letters.where("is_current AND NOT is_voided")
    replied = latest_earlier_day(
        live, ["package_id", "thread_key"], "dated", "serial", ["letter_ref", "dated"], "_prev"
    )
    return replied.select(
        "letter_id", "package_id", "serial", "review_status", "dated", "received", "letter_ref",
        "subject", "direction", "from_code", "to_code", "thread_key",
        F.col("_prev.letter_ref").alias("replies_to_ref"),
        F.col("_prev.dated").alias("replies_to_dated"),
        F.datediff("dated", F.col("_prev.dated")).alias("reply_in_days"),
    )


def missing_references(citations: DataFrame, letters: DataFrame) -> DataFrame:
    """References cited by current letters and not held, once per package and reference."""
    dates = letters.where("is_current").select(
        "package_id", F.col("letter_id").alias("citing_letter_id"), "dated"
    )
    return (
        citations.where("resolution = 'unresolved_missing'")
        .join(dates, ["package_id", "citing_letter_id"])
        .groupBy("package_id", "cited_ref_normalized")
        .agg(
            F.min("cited_ref_text").alias("first_cited_text"),
            F.count("*").alias("cited_by_count"),
            F.min("dated").alias("first_cited_on"),
        )
    )


def package_manifest(
    filings: DataFrame, documents: DataFrame, runs: DataFrame, pipeline_versions: DataFrame
) -> DataFrame:
    """Every filed document with its current run and the versions that produced it."""
    live = runs.where("is_current").select(
        "package_id", "document_id", "run_id", F.col("status").alias("run_status"), "pipeline_version"
    )
    return (
        filings.join(documents, "document_id")
        .join(live, ["package_id", "document_id"], "left")
        .join(pipeline_versions, "pipeline_version", "left")
        .select(
            "package_id", "document_id", "original_filename", "byte_size", "ingested_at",
            "run_id", "run_status", "pipeline_version", "ocr_provider", "model",
        )
    )


def letter_listing(
    letters: DataFrame, fields: DataFrame, citations: DataFrame, occurrences: DataFrame, documents: DataFrame
) -> DataFrame:
    """Register rows as the list screen shows them, with what they reply to, ordered by package and serial."""
    firsts = (
        fields.where("is_current AND field_index = 0 AND field_key IN ('chainage', 'clause')")
        .groupBy("package_id", "letter_id")
        .agg(
            F.max(F.when(F.col("field_key") == "chainage", F.col("value"))).alias("chainage"),
            F.max(F.when(F.col("field_key") == "clause", F.col("value"))).alias("clause"),
        )
    )
    missing = first_missing_citation(citations, occurrences)
    names = documents.select("document_id", "original_filename")
    live = latest_earlier_day(
        letters.where("is_current AND NOT is_voided").drop("chainage", "clause"),
        ["package_id", "thread_key"], "dated", "serial", ["letter_ref", "dated"], "_prev",
    )
    return (
        live.join(firsts, ["package_id", "letter_id"], "left")
        .join(missing, ["package_id", "letter_id"], "left")
        .join(names, "document_id", "left")
        .select(
            "package_id", "letter_id", "serial",
            F.coalesce("letter_ref", F.lit(DASH)).alias("letter_ref"),
            "dated", "received",
            F.coalesce("from_code", F.lit("UNK")).alias("from_code"),
            F.coalesce("to_code", F.lit("UNK")).alias("to_code"),
            "direction",
            F.when(F.col("direction").isNull(), "parties").alias("unresolved_field"),
            F.coalesce("subject", F.lit("")).alias("subject"),
            "chainage", "clause",
            F.coalesce("thread_key", "letter_ref", F.col("letter_id").cast("string")).alias("thread_key"),
            "review_status", "missing_citation", "document_id", "page_from", "page_to", "original_filename",
            F.col("_prev.letter_ref").alias("replies_to_ref"),
            F.col("_prev.dated").alias("replies_to_dated"),
            F.datediff("dated", F.col("_prev.dated")).alias("reply_in_days"),
        )
        .orderBy("package_id", "serial")
    )


def first_missing_citation(citations: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One missing reference per citing letter: the first mentioned, then by reference."""
    at = occurrences.groupBy(*CITATION).agg(F.min("field_index").alias("first_index"))
    return (
        citations.where("resolution = 'unresolved_missing'")
        .join(at, CITATION)
        .groupBy("package_id", F.col("citing_letter_id").alias("letter_id"))
        .agg(
            F.min_by("cited_ref_text", F.struct("first_index", "cited_ref_normalized")).alias("missing_citation")
        )
    )


def document_listing(
    filings: DataFrame, documents: DataFrame, pages: DataFrame, letters: DataFrame, runs: DataFrame
) -> DataFrame:
    """What went into a package and what came of it, newest first."""
    key = ["package_id", "document_id"]
    page_n = pages.groupBy("document_id").agg(F.count("*").alias("pages"))
    letter_n = letters.where("is_current AND NOT is_voided").groupBy(*key).agg(F.count("*").alias("letters"))
    live = runs.where("is_current").select(*key, "status", "error")
    return (
        filings.join(documents, "document_id")
        .join(page_n, "document_id", "left")
        .join(letter_n, key, "left")
        .join(live, key, "left")
        .select(
            *key, "original_filename", "byte_size", "ingested_at",
            F.coalesce("pages", F.lit(0)).alias("pages"),
            F.coalesce("letters", F.lit(0)).alias("letters"),
            F.coalesce("status", F.lit("unknown")).alias("status"),
            "error",
        )
        .orderBy(F.col("ingested_at").desc(), "package_id", "document_id")
    )


def package_header(packages: DataFrame, filings: DataFrame) -> DataFrame:
    counted = filings.groupBy("package_id").agg(F.countDistinct("document_id").alias("documents_ingested"))
    return packages.join(counted, "package_id", "left").select(
        "package_id", "name", "contract_no",
        F.coalesce("documents_ingested", F.lit(0)).alias("documents_ingested"),
    )


def field_provenance(fields: DataFrame, letters: DataFrame) -> DataFrame:
    """Current fields of current letters in viewing order, with the text to display."""
    wanted = letters.where("is_current").select("package_id", "letter_id")
    return (
        fields.where("is_current")
        .join(wanted, ["package_id", "letter_id"], "left_semi")
        .select(
            "package_id", "letter_id", "field_key", "field_index",
            display_value(F.col("field_key"), F.col("value"), F.col("verbatim")).alias("display"),
            "value", "verbatim", "page_no", "validation",
        )
        .orderBy("package_id", "letter_id", "field_key", "field_index")
    )


def page_highlights(fields: DataFrame, page_no: int) -> DataFrame:
    """Located current fields on one page number."""
    return fields.where("is_current AND validation <> 'unresolved'").where(F.col("page_no") == page_no)


def ambiguity_queue(citations: DataFrame, candidates: DataFrame, letters: DataFrame) -> DataFrame:
    """Ambiguous citations of live letters with their candidates, best first.

    One row per candidate in queue order: a citation of a reference carried by very many
    letters stays a set of rows instead of one list.
    """
    live = letters.where("is_current AND NOT is_voided")
    citing = live.select(
        "package_id", F.col("letter_id").alias("citing_letter_id"),
        F.col("letter_ref").alias("citing_ref"), F.col("serial").alias("citing_serial"),
    )
    offered = letters.select(
        "package_id", F.col("letter_id").alias("candidate_letter_id"),
        F.col("letter_ref").alias("candidate_ref"), F.col("serial").alias("candidate_serial"),
    )
    return (
        citations.where("resolution = 'unresolved_ambiguous'")
        .select(*CITATION, "cited_ref_text")
        .join(citing, ["package_id", "citing_letter_id"])
        .join(candidates, CITATION, "left")
        .join(offered, ["package_id", "candidate_letter_id"], "left")
        .select(
            "package_id", "citing_letter_id", "citing_ref", "citing_serial", "cited_ref_text",
            "candidate_letter_id", "candidate_ref", "candidate_serial", "match_method", "match_score",
        )
        .orderBy(
            "package_id", "citing_serial", "cited_ref_text",
            F.col("match_score").desc_nulls_last(), "candidate_serial",
        )
    )


def queue_page(
    citations: DataFrame, scored: DataFrame, exact: DataFrame, letters: DataFrame, after: DataFrame,
    size: int = 20, shown: int = 10,
) -> DataFrame:
    """A page of each package's ambiguity queue: `size` citations, each with its best `shown` candidates and their number.

    `after` (package_id, serial, cited_ref_text) is the last citation already seen; packages without a row, or with nulls,
    start at the front, and of several rows the furthest counts. Citations of a page are chosen first and only their references
    are looked up, so a reference that many letters cite and many have is not expanded. A citation without candidates has an
    empty list.
    """
    reference, order = ["package_id", "cited_ref_normalized"], ["citing_serial", "cited_ref_text", *CITATION[1:]]
    citing = letters.where("is_current AND NOT is_voided").select(
        "package_id", F.col("letter_id").alias("citing_letter_id"),
        F.col("letter_ref").alias("citing_ref"), F.col("serial").alias("citing_serial"),
    )
    seen = (
        after.where("package_id IS NOT NULL AND serial IS NOT NULL AND cited_ref_text IS NOT NULL")
        .groupBy("package_id")
        .agg(F.max(F.struct(F.col("serial").cast("long"), "cited_ref_text")).alias("_seen"))
    )
    unseen = F.col("_seen").isNull() | (F.struct(F.col("citing_serial").cast("long"), "cited_ref_text") > F.col("_seen"))
    page = cut_lineage(
        citations.where("resolution = 'unresolved_ambiguous'")
        .select(*CITATION, "cited_ref_text", F.coalesce(F.col("rule") == "exact_many", F.lit(False)).alias("_shared"))
        .join(citing, ["package_id", "citing_letter_id"])
        .join(seen, "package_id", "left")
        .where(unseen)
        .withColumn("place", F.row_number().over(Window.partitionBy("package_id").orderBy(*order)))
        .where(F.col("place") <= size)
        .drop("_seen")
    )
    offered = letters.select(
        "package_id", F.col("letter_id").alias("candidate_letter_id"),
        F.col("letter_ref").alias("candidate_ref"), F.col("serial").alias("candidate_serial"),
    )
    open_refs = page.where("_shared").select(*reference)
    asked = exact.join(open_refs.distinct(), reference, "left_semi")
    numbers = asked.groupBy(*reference).agg(F.count("*").alias("_held"))
    # the citing letter itself is no candidate: one more than shown is enough
    first = Window.partitionBy(*reference).orderBy(F.col("candidate_serial").asc_nulls_last(), "candidate_letter_id")
    heads = (
        asked.join(offered, ["package_id", "candidate_letter_id"], "left")
        .withColumn("_n", F.row_number().over(first))
        .where(F.col("_n") <= shown + 1)
        .drop("_n")
    )
    own = page.where("_shared").join(
        exact.withColumnRenamed("candidate_letter_id", "citing_letter_id"), CITATION, "left_semi"
    ).select(*CITATION, F.lit(1).alias("_own"))
    counted = (
        page.join(numbers.withColumn("_shared", F.lit(True)), [*reference, "_shared"], "left")
        .join(own, CITATION, "left")
        .withColumn("_held", F.coalesce("_held", F.lit(0)) - F.coalesce("_own", F.lit(0)))
        .drop("_own")
    )
    named = ["candidate_letter_id", "candidate_ref", "candidate_serial"]
    shared = (
        page.where("_shared").select(*CITATION).join(heads, reference)
        .where(F.col("candidate_letter_id") != F.col("citing_letter_id"))
        .select(*CITATION, *named, F.lit("exact_ref").alias("match_method"), F.lit(None).cast("double").alias("match_score"))
    )
    near = (
        scored.join(page.select(*CITATION), CITATION, "left_semi")
        .join(offered, ["package_id", "candidate_letter_id"], "left")
        .select(*CITATION, *named, "match_method", "match_score")
    )
    # best first: score, then serial, both with missing ones last
    entry = F.struct(
        F.col("match_score").isNull().alias("a"), (-F.col("match_score")).alias("b"),
        F.col("candidate_serial").isNull().alias("c"), F.col("candidate_serial").alias("d"),
        F.col("candidate_letter_id").alias("e"), F.struct(*named, "match_method", "match_score").alias("candidate"),
    )
    lists = shared.unionByName(near).groupBy(*CITATION).agg(
        F.sort_array(F.collect_list(entry)).alias("_all"), F.count_if(F.col("match_method") != "exact_ref").alias("_near")
    )
    best = F.transform(F.slice(F.coalesce("_all", F.array()), 1, shown), lambda e: e["candidate"])
    return counted.join(lists, CITATION, "left").select(
        "package_id", "place", "citing_letter_id", "citing_ref", "citing_serial", "cited_ref_normalized", "cited_ref_text",
        (F.col("_held") + F.coalesce("_near", F.lit(0))).alias("n_candidates"), best.alias("candidates"),
    )


def latest_rasters(pages: DataFrame) -> DataFrame:
    """The page image of the highest pipeline version."""
    return pages.groupBy("document_id", "page_no").agg(
        F.max("pipeline_version").alias("pipeline_version"),
        F.max_by("raster_uri", "pipeline_version").alias("raster_uri"),
    )


def owned_by(rows: DataFrame, packages: DataFrame, owner: str | int) -> DataFrame:
    """Rows of the packages a user owns; works for letters, citations and filings alike."""
    mine = packages.where(F.col("owner_user_id") == F.lit(owner)).select("package_id")
    return rows.join(mine, "package_id", "left_semi")


def owned_documents(documents: DataFrame, filings: DataFrame, packages: DataFrame, owner: str | int) -> DataFrame:
    """Documents filed in at least one package of the user."""
    reachable = owned_by(filings, packages, owner).select("document_id")
    return documents.join(reachable, "document_id", "left_semi")
