"""Every operator as a query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields as fv
from ..functions import refs
from ..operators import (
    assembly,
    audit,
    checks,
    citations,
    completeness,
    provenance,
    register,
    reprocessing,
    search,
    threads,
    versions,
)
from ..session import checkpoint_root, cut_lineage, grown
from ..sources import extraction, intake
from . import bridge
from .linked import assembled_pages, bridged, extracted_fields, linked, mentions, page_buckets, page_ocr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- sources and intake


def _text_files(spark: SparkSession, d: str) -> DataFrame:
    return bridge.table(spark, d, "documents").select(
        "doc_id",
        (F.col("doc_id") % 7).alias("package_id"),
        F.concat(F.lit("upload/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )


@query
def a1_content_hash_intake(spark, d):
    return intake.intake(_text_files(spark, d))


def _classified(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    arrivals = _text_files(spark, d).select(
        "package_id", F.sha2("content", 256).alias("sha256"), F.col("doc_id").alias("arrival")
    )
    stored = arrivals.where("arrival % 10 = 0")
    return intake.classify_intake(arrivals, stored, stored, stored.where("arrival % 20 = 0")), stored, arrivals


@query
def a2_duplicate_classes(spark, d):
    return _classified(spark, d)[0]


@query
def a2_rows_to_insert(spark, d):
    classified, stored, _ = _classified(spark, d)
    documents, filings = intake.rows_to_insert(classified, stored, stored)
    return documents.select("sha256", F.lit(None).cast("long").alias("package_id")).unionByName(
        filings.select("sha256", "package_id")
    )


@query
def a3_storage_keys(spark, d):
    files = _text_files(spark, d).select("doc_id", F.sha2("content", 256).alias("sha256"))
    return files.select(
        "doc_id",
        intake.original_key(F.col("sha256")).alias("original"),
        intake.raster_key(F.lit("v3"), F.col("sha256"), F.col("doc_id") % 2000).alias("raster"),
    )


@query
def a4_integrity_audit(spark, d):
    texts = bridge.table(spark, d, "documents").where("doc_id % 89 <> 0").select("doc_id", "text")
    recorded = bridge.table(spark, d, "documents").where("doc_id % 83 <> 0").select(
        F.sha2("text", 256).alias("sha256")
    ).distinct()
    blobs = texts.groupBy(intake.original_key(F.sha2("text", 256)).alias("key")).agg(
        F.min("doc_id").alias("doc_id"), F.min("text").alias("text")
    ).select(
        "key",
        F.encode(
            F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "utf-8"
        ).alias("content"),
    )
    return intake.audit_integrity(recorded, blobs)


def _parsed(spark: SparkSession, d: str) -> extraction.Parsed:
    return extraction.parse_extractions(bridge.extraction_files(*bridged(spark, d)))


@query
def a5_candidate_letters(spark, d):
    return _parsed(spark, d).candidates


@query
def a5_candidate_fields(spark, d):
    return _parsed(spark, d).fields


@query
def a5_unreadable(spark, d):
    return _parsed(spark, d).errors




@query
def a6_document_bundle(spark, d):
    bundle = extraction.bundle_pages(page_ocr(spark, d))
    return bundle.select("document_id", F.sha2("bundle", 256).alias("bundle_hash"), F.length("bundle").alias("n"))


@query
def a7_page_assembly(spark, d):
    token = F.element_at("tokens", -1)
    return assembled_pages(spark, d, page_buckets(spark, d)).select(
        "document_id", "page_no", F.sha2("text", 256).alias("text_hash"),
        F.size("tokens").alias("n_tokens"),
        token["char_start"].alias("last_start"), token["char_end"].alias("last_end"),
        F.round(token["bbox"]["x"], 6).alias("last_x"), F.round(token["bbox"]["y"], 6).alias("last_y"),
        F.round(
            F.aggregate("tokens", F.lit(0.0), lambda s, t: s + t["confidence"]), 4
        ).alias("confidence_sum"),
        F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + t["char_start"]).alias("start_sum"),
    )


@query
def a9_upload_outcome(spark, d):
    classified, _, _ = _classified(spark, d)
    arrivals = classified.select("package_id", "sha256", "arrival")
    found = arrivals.where("arrival % 3 = 0")
    merged = arrivals.where("arrival % 5 = 0").withColumn(
        "letter_ref", F.concat(F.lit("REF/"), F.col("arrival").cast("string"))
    )
    errors = arrivals.where("arrival % 11 = 0").withColumn("error", F.lit("no answer"))
    return intake.upload_report(classified, found, merged, errors)


@query
def a9_merged_references(spark, d):
    classified, _, _ = _classified(spark, d)
    merged = classified.where("arrival % 5 = 0").select(
        "package_id", "sha256", F.concat(F.lit("REF/"), (F.col("arrival") % 7).cast("string")).alias("letter_ref")
    )
    return intake.merged_references(classified, merged)


@query
def a10_snapshot_sink(spark, d):
    path = f"{checkpoint_root(spark)}/snapshot-{uuid.uuid4().hex}"
    letters = linked(spark, d).letters.select("package_id", "letter_id", "serial", "letter_ref")
    intake.save(letters, path, 1)
    return intake.load(spark, path, 1).select(F.col("package_id").cast("long").alias("package_id"), "letter_id", "serial", "letter_ref")


# -- provenance and checks


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return bridge.page_claims(page_ocr(spark, d))


@query
def c1_verbatim_location(spark, d):
    return provenance.locate_verbatim(_claims(spark, d), page_ocr(spark, d)).select(
        "document_id", "page", "claim_no", "validation", "char_start", "char_end"
    )


@query
def c2_span_rectangles(spark, d):
    assembled = page_ocr(spark, d)
    boxed = provenance.map_spans(provenance.locate_verbatim(_claims(spark, d), assembled), assembled)
    return boxed.where("bbox IS NOT NULL").select(
        "document_id", "page", "claim_no", F.size("bbox.rects").alias("n_rects"),
        *[F.round(f"bbox.union.{c}", 6).alias(f"box_{c}") for c in "xywh"],
        F.round(F.col("bbox.rects")[0]["x"], 6).alias("first_x"),
    )


@query
def c3_stored_fields(spark, d):
    """The claims of every ninth document name a page that was never read."""
    claims = _claims(spark, d).withColumns(
        {"claimed": F.col("page"), "page": F.when(F.col("document_id") % 9 == 0, 999_999).otherwise(F.col("page"))}
    )
    return provenance.build_fields(claims, page_ocr(spark, d)).select(
        "document_id", "claimed", "claim_no", "validation", "char_start", "char_end", "page_no",
        F.coalesce(F.size("bbox.rects"), F.lit(0)).alias("n_rects"),
    )


@query
def c4_token_audit(spark, d):
    """Tokens of every tenth document are moved by one to give the audit something to find."""
    moved = F.transform(
        "tokens",
        lambda t: t.withField("char_start", t["char_start"] + 1).withField("char_end", t["char_end"] + 1),
    )
    assembled = page_ocr(spark, d).withColumn(
        "tokens", F.when(F.col("document_id") % 10 == 0, moved).otherwise(F.col("tokens"))
    )
    found = provenance.audit_tokens(assembled)
    return found.groupBy("document_id").agg(F.count("*").alias("broken"), F.min("token_no").alias("first_token"))


@query
def c5_type_checks(spark, d):
    held = linked(spark, d)
    packages = bridge.packages(held.letters)
    clauses = packages.select("package_id", F.lit("Cl. 17.3").alias("clause"))
    return checks.check_types(extracted_fields(spark, d), packages, clauses)


@query
def c6_anomalies(spark, d):
    held = linked(spark, d)
    late = held.letters.withColumn(
        "received", F.when(F.col("letter_id") % 43 == 0, F.date_sub("dated", 2)).otherwise(F.col("received"))
    )
    return checks.flag_anomalies(late, bridge.packages(held.letters), held.citations)


@query
def c7_review_status(spark, d):
    held = linked(spark, d)
    return checks.review_status(held.letters, extracted_fields(spark, d), held.citations)


@query
def c8_triage(spark, d):
    return checks.triage(extracted_fields(spark, d))


@query
def c8_unresolved_fields(spark, d):
    return checks.unresolved_fields(extracted_fields(spark, d))


# -- assembly, serials, versions


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """One candidate per letter; some blank, some repeating the reference of another."""
    k = F.col("letter_id")
    blank = k % 41 == 0
    ref = F.when(
        k % 37 == 0, F.concat(F.lit("REPEAT/"), (F.floor(k / 370)).cast("string"))
    ).otherwise(F.col("letter_ref"))

    def unless_blank(value: F.Column) -> F.Column:
        return F.when(~blank, value)

    return bridged(spark, d).letters.select(
        "package_id", "document_id", k.alias("candidate"),
        unless_blank(ref).alias("letter_ref"),
        refs.normalize_ref(unless_blank(ref)).alias("letter_ref_normalized"),
        unless_blank(F.col("dated")).alias("dated"),
        unless_blank(F.col("subject")).alias("subject"),
        unless_blank(bridge._party_text("from_code")).alias("from_text"),
        unless_blank(bridge._party_text("to_code")).alias("to_text"),
        "page_from", "page_to",
    )


@query
def d1_blank_candidates(spark, d):
    return assembly.split_blank(_candidates(spark, d))[1].select("package_id", "document_id", "candidate")


def _existing(spark: SparkSession, d: str) -> DataFrame:
    return bridged(spark, d).letters.where("letter_id % 13 = 0")


@query
def d2_merged_repeats(spark, d):
    found = assembly.merge_existing(assembly.split_blank(_candidates(spark, d))[0], _existing(spark, d))
    return found.repeats


@query
def d2_fresh_candidates(spark, d):
    found = assembly.merge_existing(assembly.split_blank(_candidates(spark, d))[0], _existing(spark, d))
    parties = bridge.parties(bridge.packages(bridged(spark, d).letters))
    return assembly.resolve_parties(found.fresh, parties).select(
        "package_id", "document_id", "candidate", "letter_ref_normalized", "from_code", "to_code", "direction"
    )


@query
def d3_serial_numbers(spark, d):
    packages = bridge.packages(bridged(spark, d).letters).withColumn("next_serial", F.col("package_id") * 10 + 1)
    numbered, _ = assembly.assign_serials(assembly.split_blank(_candidates(spark, d))[0], packages)
    return numbered.select("package_id", "candidate", "serial")


@query
def d4_reference_collisions(spark, d):
    k = F.col("letter_id")
    shared = bridged(spark, d).letters.withColumn(
        "letter_ref",
        F.when(k % 37 == 0, F.concat(F.lit("REPEAT/"), F.floor(k / 370).cast("string"))).otherwise(F.col("letter_ref")),
    )
    return assembly.ref_collisions(shared)


def _rerun(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Current letters and the candidates of a second reading: same, corrected, moved or new."""
    k = F.col("letter_id")
    letters = bridged(spark, d).letters.where("is_current").withColumn(
        "letter_ref_normalized",
        F.when(k % 6 == 0, F.concat(F.lit("SHARED/"), F.col("document_id"))).otherwise(F.col("letter_ref")),
    )
    # three letters of one document share a package here, as in a real file
    letters = letters.withColumn("package_id", F.floor(k / 300))
    candidates = letters.select(
        "package_id", "document_id", k.alias("candidate"),
        F.when(k % 4 == 1, F.concat("letter_ref", F.lit("X")))
        .when(k % 8 == 2, F.lit(None))
        .when(k % 8 == 7, F.concat(F.lit("SHARED/"), F.col("document_id")))
        .otherwise(F.col("letter_ref_normalized"))
        .alias("letter_ref_normalized"),
        F.when(k % 5 == 0, F.col("page_from") + 20).otherwise(F.col("page_from")).cast("int").alias("page_from"),
        F.when(k % 5 == 0, F.col("page_to") + 20).otherwise(F.col("page_to")).cast("int").alias("page_to"),
    )
    return letters, candidates


@query
def d5_reprocessing_match(spark, d):
    existing, candidates = _rerun(spark, d)
    return reprocessing.match_reprocessed(existing, candidates).drop("letter_ref_normalized", "page_from", "page_to")


@query
def d6_supersession(spark, d):
    existing, candidates = _rerun(spark, d)
    packages = existing.groupBy("package_id").agg((F.max("letter_id") + 1).alias("next_serial"))
    numbered = existing.withColumns(
        {"serial": F.col("letter_id"), "superseded_by": F.lit(None).cast("string")}
    )
    after, _ = reprocessing.apply_reprocessing(
        numbered, reprocessing.match_reprocessed(numbered, candidates), packages
    )
    return after.select(
        "package_id", "document_id", "serial", "letter_ref_normalized", "page_from", "is_current",
        F.col("superseded_by").isNotNull().alias("replaced"), "review_status",
    )


@query
def d6_flag_events(spark, d):
    existing, candidates = _rerun(spark, d)
    packages = existing.groupBy("package_id").agg((F.max("letter_id") + 1).alias("next_serial"))
    numbered = existing.withColumns(
        {"serial": F.col("letter_id"), "superseded_by": F.lit(None).cast("string")}
    )
    _, events = reprocessing.apply_reprocessing(
        numbered, reprocessing.match_reprocessed(numbered, candidates), packages
    )
    return events.groupBy("actor", "action", "note").agg(F.count("*").alias("n"))


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    """Line items of an order as the versions of one logical letter."""
    items = bridge.requests(spark, d).groupBy("run_id", "letter_id").agg(F.min("started_at").alias("created_at"))
    return items.select(
        (F.col("letter_id") % 50).alias("package_id"), F.col("letter_id").alias("serial"),
        F.col("run_id").alias("letter_id"), "created_at",
    )


@query
def d7_version_history(spark, d):
    return versions.history(_versioned(spark, d))


@query
def d7_as_of(spark, d):
    return versions.as_of(_versioned(spark, d), F.lit("1998-06-30").cast("date"))


@query
def d7_as_of_each(spark, d):
    """Every letter at as many moments as it has versions, up to thirty days beside them."""
    letters = _versioned(spark, d)
    beside = F.date_add("created_at", (F.col("letter_id") % 61 - 30).cast("int"))
    return versions.as_of_each(letters, letters.select("package_id", "serial", beside.alias("moment")))


def _actions(fields: DataFrame) -> DataFrame:
    n = F.col("field_id")
    chosen = fields.where(n % 13 == 0).select(
        "field_id", "letter_id",
        F.when(n % 3 == 0, "verified").when(n % 3 == 1, "rejected").otherwise("corrected").alias("action"),
        n.alias("acted_at"),
    )
    again = chosen.where(n % 2 == 0).withColumns(
        {"action": F.lit("verified"), "acted_at": F.col("acted_at") + 1}
    )
    return chosen.unionByName(again).select(
        "field_id", "action", F.lit("reviewer").alias("actor"),
        F.concat(F.lit("NEW "), n.cast("string")).alias("new_value"), F.lit("checked").alias("note"), "acted_at",
    )


@query
def d8_reviewed_fields(spark, d):
    fields = extracted_fields(spark, d)
    return versions.apply_review(fields, _actions(fields))[0].drop("verbatim", "document_id", "page_no")


@query
def d8_review_events(spark, d):
    fields = extracted_fields(spark, d)
    return versions.apply_review(fields, _actions(fields))[1]


@query
def d9_void_and_serial_audit(spark, d):
    letters = bridged(spark, d).letters
    actions = letters.where("letter_id % 71 = 0").select("letter_id", F.lit("misfiled").alias("reason"))
    twice = letters.withColumn(
        "serial", F.when(F.col("letter_id") % 101 == 0, F.col("serial") + 1).otherwise(F.col("serial"))
    )
    return versions.serial_audit(versions.void(twice, actions))


@query
def d10_letter_projection(spark, d):
    return versions.project_letters(extracted_fields(spark, d))


@query
def d11_run_publication(spark, d):
    runs = bridge.runs(spark, d, linked(spark, d).letters)
    return versions.publish_runs(runs).select("run_id", "status", "is_current", "superseded_by", "error")


@query
def d12_chainage_ranges(spark, d):
    fields = extracted_fields(spark, d)
    ranged = fields.withColumn(
        "value",
        F.when(
            (F.col("field_key") == "chainage") & (F.col("letter_id") % 3 == 0),
            F.concat("value", F.lit(" – Km 91+250")),
        ).otherwise(F.col("value")),
    )
    return versions.chainages(ranged)


@query
def d12_clauses(spark, d):
    return versions.clauses(extracted_fields(spark, d))


@query
def d13_source_backfill(spark, d):
    links = linked(spark, d).citations
    unknown = links.withColumn(
        "resolution_source", F.when(F.col("citing_letter_id") % 2 == 0, F.col("resolution_source"))
    )
    return citations.backfill_source(unknown).select(
        "citing_letter_id", "cited_ref_normalized", "resolution", "resolution_source"
    )


# -- citation resolution


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    letters, cited = bridged(spark, d)
    return letters, mentions(letters, cited)


def _direct(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    letters, found = _inputs(spark, d)
    targets = grown(cut_lineage(citations.link_targets(letters)))
    direct = citations.apply_direct_rules(citations.distinct_citations(found), targets)
    return cut_lineage(direct), targets


def _by_rule(spark: SparkSession, d: str, *rules: str) -> DataFrame:
    letters, found = _inputs(spark, d)
    direct = citations.apply_direct_rules(citations.distinct_citations(found), citations.link_targets(letters))
    return direct.where(F.col("rule").isin(*rules)).select(
        "package_id", "citing_letter_id", "cited_ref_normalized", F.col("direct_id").alias("cited_letter_id")
    )


@query
def e1_exact_links(spark, d):
    return _by_rule(spark, d, "exact")


@query
def e1_exact_ambiguous(spark, d):
    """Every reference loses its last two digits, so many letters share one."""
    letters, found = _inputs(spark, d)
    short = F.expr("substr(cited_ref_normalized, 1, length(cited_ref_normalized) - 3)")
    shared = letters.withColumn("letter_ref", F.expr("substr(letter_ref, 1, length(letter_ref) - 3)"))
    direct = citations.apply_direct_rules(
        citations.distinct_citations(found.withColumn("cited_ref_normalized", short)),
        citations.link_targets(shared),
    )
    return direct.where("rule IN ('exact', 'exact_many')").select(
        "citing_letter_id", "cited_ref_normalized", "rule", "direct_id"
    )


@query
def e2_punctuation_blind_links(spark, d):
    return _by_rule(spark, d, "punctuation")


def _aliases(held) -> DataFrame:
    """Confirmed meanings for some references that no direct rule resolves."""
    return (
        held.citations.where("rule IS NULL AND citing_letter_id % 3 = 0")
        .join(
            grown(held.letters.where("is_current AND NOT is_voided").groupBy("package_id").agg(F.min("letter_id").alias("letter_id"))),
            "package_id",
        )
        .select("package_id", "cited_ref_normalized", "letter_id")
        .distinct()
    )


@query
def e3_alias_links(spark, d):
    held = linked(spark, d)
    targets = citations.link_targets(held.letters)
    found = citations.distinct_citations(mentions(held.letters, held.cited))
    direct = citations.apply_direct_rules(found, targets, _aliases(held))
    return direct.where("rule = 'alias'").select(
        "citing_letter_id", "cited_ref_normalized", F.col("direct_id").alias("cited_letter_id")
    )


@query
def e4_trigram_candidates(spark, d):
    direct, targets = _direct(spark, d)
    fuzzy = citations.fuzzy_candidates(direct.where("rule IS NULL"), targets)
    return fuzzy.select(
        "citing_letter_id", "cited_ref_normalized", "candidate_letter_id",
        F.round("match_score", 6).alias("match_score"), "place",
    )


def _one_great_package(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A third of all customers' letters in package 0; letter numbers are the serials."""
    letters, cited = bridged(spark, d)
    great = F.when(F.col("cust") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("package_id"))
    letters = letters.withColumns({"package_id": great, "serial": F.col("letter_id")})
    return letters, cited.drop("package_id").join(grown(letters).select("letter_id", "package_id"), "letter_id")


@query
def e4_great_package(spark, d):
    letters, cited = _one_great_package(spark, d)
    targets = grown(cut_lineage(citations.link_targets(letters)))
    direct = citations.apply_direct_rules(citations.distinct_citations(mentions(letters, cited)), targets)
    fuzzy = citations.fuzzy_candidates(cut_lineage(direct).where("rule IS NULL"), targets)
    return fuzzy.select(
        "package_id", "citing_letter_id", "cited_ref_normalized", "candidate_letter_id",
        F.round("match_score", 6).alias("match_score"), "place",
    )


@query
def e5_serial_anchored(spark, d):
    direct, targets = _direct(spark, d)
    found = citations.anchored(citations.fuzzy_candidates(direct.where("rule IS NULL"), targets))
    return found.select(
        "citing_letter_id", "cited_ref_normalized", "candidate_letter_id", F.round("body_ratio", 6).alias("body_ratio")
    )


@query
def e6_resolution_states(spark, d):
    links = linked(spark, d).citations
    return links.groupBy("package_id", "resolution", "rule").agg(F.count("*").alias("n"))


def _stored_links(held) -> DataFrame:
    """An older state of the links: some decided by a person, some outdated, some not there yet."""
    n = F.col("citing_letter_id")
    return held.citations.where(n % 5 != 0).withColumns(
        {
            "resolution_source": F.when(n % 7 == 0, "human").otherwise("pipeline"),
            "resolution": F.when(n % 7 == 0, "resolved").otherwise("unresolved_missing"),
            "cited_letter_id": F.when(n % 7 == 0, F.lit(1).cast("long")),
            "cited_ref_text": F.concat(F.lit("first: "), F.col("cited_ref_text")),
        }
    ).drop("rule")


@query
def e7_upsert_links(spark, d):
    held = linked(spark, d)
    return citations.upsert(_stored_links(held), held.citations)


@query
def e8_occurrences(spark, d):
    held = linked(spark, d)
    return citations.occurrences(mentions(held.letters, held.cited), _stored_links(held))


@query
def e9_candidate_rows(spark, d):
    return linked(spark, d).candidates.withColumn("match_score", F.round("match_score", 6))


def _confirmations(held) -> DataFrame:
    """Every third citation with candidates: its lowest candidate, and for some a letter never offered."""
    key = ["package_id", "citing_letter_id", "cited_ref_normalized"]
    first = held.candidates.groupBy(*key).agg(F.min("candidate_letter_id").alias("candidate_letter_id"))
    chosen = first.where("citing_letter_id % 3 = 0").withColumn("confirmed_at", F.col("citing_letter_id") * 2)
    wrong = first.where("citing_letter_id % 9 = 0").withColumns(
        {"candidate_letter_id": F.lit(-1).cast("long"), "confirmed_at": F.col("citing_letter_id") * 2 + 1}
    )
    return chosen.unionByName(wrong)


@query
def e10_confirmed_links(spark, d):
    held = linked(spark, d)
    linked_rows, _, _ = citations.confirm(held.citations, held.candidates, _confirmations(held))
    return linked_rows.where("resolution_source = 'human'").select(
        "citing_letter_id", "cited_ref_normalized", "cited_letter_id", "resolution"
    )


@query
def e10_learned_aliases(spark, d):
    held = linked(spark, d)
    return citations.confirm(held.citations, held.candidates, _confirmations(held))[1]


@query
def e10_rejected_confirmations(spark, d):
    held = linked(spark, d)
    return citations.confirm(held.citations, held.candidates, _confirmations(held))[2]


def _confirmed(held) -> citations.Confirmed:
    return citations.apply_confirmations(
        held.citations, held.candidates, _confirmations(held), mentions(held.letters, held.cited), held.letters
    )


@query
def e10_rethreaded(spark, d):
    """The threads that confirmations leave: components brought up to date from the stored ones."""
    held = linked(spark, d)
    _, before = threads.live_links(held.letters, held.citations)
    components = threads.updated_components(held.components, before, held.letters, _confirmed(held).citations)
    summary = threads.summarize_threads(held.letters, components)
    return threads.point_letters(held.letters.drop("thread_key"), components, summary).where("thread_key IS NOT NULL").select(
        "package_id", "letter_id", "thread_key"
    )


@query
def e10_reresolved_links(spark, d):
    """Confirmations, the aliases they teach, and all links of the packages with these."""
    return _confirmed(linked(spark, d)).citations.select(
        "package_id", "citing_letter_id", "cited_ref_normalized", "cited_letter_id", "resolution", "resolution_source"
    )


@query
def e11_package_resolution(spark, d):
    letters, found = _inputs(spark, d)
    return citations.resolve(found, letters).citations


# -- threads


@query
def f1_connected_components(spark, d):
    held = linked(spark, d)
    return threads.thread_components(held.letters, held.citations)


@query
def f1_updated_components(spark, d):
    """From the components of an earlier state: a seventh of the letters not there yet, some since voided, links lost and won."""
    held = linked(spark, d)
    k, n = F.col("letter_id"), F.col("citing_letter_id")
    earlier = held.letters.where(k % 7 != 0).withColumns({"is_current": F.lit(True), "is_voided": k % 61 == 0})
    wrong = F.when(n % 13 == 0, n - 1).otherwise(F.col("cited_letter_id"))
    links = held.citations.where(n % 5 != 0).withColumn("cited_letter_id", wrong)
    _, before = threads.live_links(earlier, links)
    known = threads.thread_components(earlier, links)
    return threads.updated_components(known, before, held.letters, held.citations)


@query
def f2_thread_summary(spark, d):
    held = linked(spark, d)
    return threads.summarize_threads(held.letters, held.components)


def _stored_threads(held) -> DataFrame:
    """Two thirds of the threads at version 4 with an old subject, and some that lost all letters."""
    n = F.col("component")
    known = held.summary.where(n % 3 != 0).select(
        "package_id", "thread_key", F.lit("old subject").alias("subject"), "first_dated", "last_dated",
        F.lit(99).cast("long").alias("letter_count"), F.lit(4).alias("thread_version"),
    )
    gone = known.where("thread_key LIKE '%1'").withColumn("thread_key", F.concat(F.lit("GONE/"), F.col("thread_key")))
    return known.unionByName(gone)


@query
def f3_f5_thread_versions(spark, d):
    held = linked(spark, d)
    return threads.upsert_threads(_stored_threads(held), held.summary)


def _memberships(held) -> DataFrame:
    now = threads.upsert_threads(_stored_threads(held), held.summary)
    return threads.memberships(now, held.summary, held.components)


@query
def f4_membership_log(spark, d):
    return _memberships(linked(spark, d))


@query
def f6_threads_as_of(spark, d):
    held = linked(spark, d)
    log = _memberships(held)
    earlier = log.where("letter_id % 2 = 0").withColumn("thread_version", F.col("thread_version") - 1)
    return threads.threads_as_of(log.unionByName(earlier), 4)


@query
def f7_thread_of_letter(spark, d):
    held = linked(spark, d)
    wanted = held.letters.where("letter_ref LIKE '%77'").select("package_id", "letter_id")
    return threads.thread_of_letter(held.letters.where("is_current AND NOT is_voided"), wanted).select(
        "package_id", "thread_key", "letter_id", "dated", "serial"
    )


# -- register and listings


def _with_parties(held) -> DataFrame:
    parties = bridge.parties(bridge.packages(held.letters))
    place = {"CTR": 0, "AE": 1, "PD": 2}

    def party_id(code: str) -> F.Column:
        n = F.when(F.col(code) == "CTR", place["CTR"]).when(F.col(code) == "AE", place["AE"]).otherwise(place["PD"])
        return F.col("package_id") * 10 + n

    by_id = held.letters.withColumns(
        {"from_party_id": party_id("from_code"), "to_party_id": party_id("to_code")}
    ).drop("from_code", "to_code")
    return register.with_party_codes(by_id, parties)


@query
def g1_register(spark, d):
    return register.register(_with_parties(linked(spark, d)))


@query
def g2_missing_references(spark, d):
    held = linked(spark, d)
    return register.missing_references(held.citations, held.letters)


def _published(spark: SparkSession, d: str) -> DataFrame:
    return versions.publish_runs(bridge.runs(spark, d, linked(spark, d).letters))


@query
def g3_package_manifest(spark, d):
    letters = linked(spark, d).letters
    used = bridge.table(spark, d, "lineitem").select(
        F.concat(F.lit("v"), (F.col("l_linenumber") % 3 + 1).cast("string")).alias("pipeline_version")
    ).distinct()
    known = used.withColumns({"ocr_provider": F.lit("boxes"), "model": F.concat(F.lit("model-"), "pipeline_version")})
    return register.package_manifest(
        bridge.filings(letters), bridge.documents(letters), _published(spark, d), known
    )


@query
def g4_letter_listing(spark, d):
    held = linked(spark, d)
    return register.letter_listing(
        held.letters, extracted_fields(spark, d), held.citations, held.occurrences, bridge.documents(held.letters)
    )


@query
def g5_document_listing(spark, d):
    letters = linked(spark, d).letters
    return register.document_listing(
        bridge.filings(letters), bridge.documents(letters), bridge.document_pages(letters), letters, _published(spark, d)
    )


@query
def g6_package_header(spark, d):
    letters = linked(spark, d).letters
    return register.package_header(bridge.packages(letters), bridge.filings(letters))


@query
def g7_field_provenance(spark, d):
    return register.field_provenance(extracted_fields(spark, d), linked(spark, d).letters)


@query
def g7_page_highlights(spark, d):
    return register.page_highlights(extracted_fields(spark, d), 2).select("field_id", "field_key", "value")


@query
def g8_ambiguity_queue(spark, d):
    held = linked(spark, d)
    return register.ambiguity_queue(held.citations, held.candidates, held.letters).withColumn(
        "match_score", F.round("match_score", 6)
    )


@query
def g8_queue_page(spark, d):
    """Five citations of each package's queue with their three best candidates; every second package goes on behind serial 40."""
    held = linked(spark, d)
    after = held.letters.where("package_id % 2 = 0").select(
        "package_id", F.lit(40).alias("serial"), F.lit("~").alias("cited_ref_text")
    ).distinct()
    page = register.queue_page(held.citations, held.scored, held.exact, held.letters, after, size=5, shown=3)
    return page.select(
        "package_id", "place", "citing_letter_id", "cited_ref_text", "n_candidates", F.posexplode_outer("candidates").alias("i", "c")
    ).select(
        "package_id", "place", "citing_letter_id", "cited_ref_text", "n_candidates", (F.col("i") + 1).alias("rank"),
        "c.candidate_letter_id", "c.candidate_ref", "c.match_method", F.round("c.match_score", 6).alias("match_score"),
    )


@query
def g9_first_missing_citation(spark, d):
    held = linked(spark, d)
    return register.first_missing_citation(held.citations, held.occurrences)


@query
def g10_latest_rasters(spark, d):
    return register.latest_rasters(bridge.document_pages(linked(spark, d).letters))


@query
def g11_owned_letters(spark, d):
    letters = linked(spark, d).letters
    return register.owned_by(letters, bridge.packages(letters), 1).select("package_id", "letter_id")


@query
def g11_owned_citations(spark, d):
    held = linked(spark, d)
    return register.owned_by(held.citations, bridge.packages(held.letters), 1).select(
        "package_id", "citing_letter_id", "cited_ref_normalized"
    )


@query
def g11_owned_documents(spark, d):
    letters = linked(spark, d).letters
    return register.owned_documents(
        bridge.documents(letters), bridge.filings(letters), bridge.packages(letters), 1
    ).select("document_id")


# -- filters, chronology, search


def _live(held) -> DataFrame:
    return held.letters.where("is_current AND NOT is_voided")


@query
def h1_register_filter(spark, d):
    return search.filter_register(
        _live(linked(spark, d)), "1996-01-01", "1999-12-31", 10000, 60000, "inward", "CTR"
    ).select("package_id", "letter_id", "dated", "chainage")


@query
def h2_chainage_overlap(spark, d):
    ranges = versions.chainages(extracted_fields(spark, d)).select("package_id", "letter_id", "lo", "hi")
    return search.chainage_overlap_join(ranges, bridge.sections(spark, d))


@query
def h2_on_chainage(spark, d):
    return search.on_chainage(versions.chainages(extracted_fields(spark, d)), 20000, 31000)


@query
def h3_clause_filter(spark, d):
    letters = linked(spark, d).letters
    return search.on_clause(letters, versions.clauses(extracted_fields(spark, d)), "Cl. 17.3").select("package_id", "letter_id")


@query
def h4_chronological(spark, d):
    return search.chronological(_live(linked(spark, d))).select("package_id", "letter_id", "dated", "serial")


@query
def h5_thread_gaps(spark, d):
    return search.thread_gaps(_live(linked(spark, d)))


@query
def h6_thread_spans(spark, d):
    return search.thread_spans(_live(linked(spark, d)))


@query
def h7_package_summary(spark, d):
    held = linked(spark, d)
    return search.package_summary(_live(held), bridge.packages(held.letters), "PKG-1")


def _searchable(held) -> DataFrame:
    return _live(held).join(grown(bridge.documents(held.letters)).select("document_id", "original_filename"), "document_id")


@query
def h8_keyword_search(spark, d):
    return search.keyword_search(_searchable(linked(spark, d)), "Box Culvert 1998")


@query
def h8_top_hits(spark, d):
    return search.keyword_search(_searchable(linked(spark, d)), "shifting of box", limit=25)


@query
def h9_suggestion_index(spark, d):
    return search.suggestion_index(_searchable(linked(spark, d)))


@query
def h10_suggestion_match(spark, d):
    return search.match_suggestions(search.suggestion_index(_searchable(linked(spark, d))), "cul")


@query
def h10_completions(spark, d):
    """All prefixes of two to four signs of every package at once."""
    return search.completions(search.suggestion_index(_searchable(linked(spark, d))))


@query
def h11_semantic_nearest(spark, d):
    vectors = bridge.table(spark, d, "embeddings")
    return search.semantic_nearest(vectors, vectors.where("vec_id % 20 = 0"), 10)


@query
def h12_needs_review_register(spark, d):
    held = linked(spark, d)
    status = checks.review_status(held.letters, extracted_fields(spark, d), held.citations)
    rows = _live(held).drop("review_status").join(grown(status), ["package_id", "letter_id"])
    return search.filter_register(rows, date_from="1997-01-01", status="needs_review").select("package_id", "letter_id")


# -- aggregates and audits


@query
def i1_usage_drift(spark, d):
    return completeness.usage_drift(bridge.runs(spark, d, linked(spark, d).letters), bridge.requests(spark, d))


@query
def i1_usage_totals(spark, d):
    return completeness.usage_totals(bridge.runs(spark, d, linked(spark, d).letters), bridge.requests(spark, d))


@query
def i2_completeness(spark, d):
    held = linked(spark, d)
    missing = register.missing_references(held.citations, held.letters)
    return completeness.completeness(
        bridge.packages(held.letters), bridge.filings(held.letters), _published(spark, d), held.letters, missing
    )


@query
def j1_letter_rules(spark, d):
    """Letters with planted faults: crossed pages, unknown states, a serial used twice."""
    k = F.col("letter_id")
    faulty = linked(spark, d).letters.withColumns(
        {
            "page_from": F.when(k % 211 == 0, 9).otherwise(F.col("page_from")),
            "review_status": F.when(k % 307 == 0, "odd").otherwise(F.col("review_status")),
            "direction": F.when(k % 401 == 0, "sideways").otherwise(F.col("direction")),
            "serial": F.when(k % 503 == 0, F.col("serial") + 1).otherwise(F.col("serial")),
        }
    )
    return audit.audit_letters(faulty)


@query
def j1_field_rules(spark, d):
    n = F.col("field_id")
    faulty = extracted_fields(spark, d).withColumns(
        {
            "page_no": F.when(n % 997 == 0, None).when(n % 991 == 0, 3).otherwise(F.col("page_no")),
            "validation": F.when(n % 983 == 0, "guessed").otherwise(F.col("validation")),
            "letter_id": F.when(n % 977 == 0, -1).otherwise(F.col("letter_id")),
        }
    )
    return audit.audit_fields(faulty, linked(spark, d).letters)


@query
def j1_geometry_rules(spark, d):
    """Stored claims with planted faults: an end at its start, a box lost, an offset without a place."""
    n, found = F.col("document_id"), F.col("validation") != "unresolved"
    claims = _claims(spark, d).withColumn("claimed", F.col("page"))
    faulty = provenance.build_fields(claims, page_ocr(spark, d)).withColumns(
        {
            "char_end": F.when(found & (n % 13 == 0), F.col("char_start")).otherwise(F.col("char_end")),
            "bbox": F.when(n % 17 != 0, F.col("bbox")),
            "char_start": F.when(~found & (n % 19 == 0), 0).otherwise(F.col("char_start")),
        }
    )
    return audit.audit_geometry(faulty, F.concat_ws("/", "document_id", "claimed", "claim_no"))


@query
def j1_source_rules(spark, d):
    """Fields with planted faults: some from a run of another document, some on a page that was not read."""
    run = F.concat(F.lit("run-"), "document_id")
    letters = bridged(spark, d).letters.withColumn("run_id", run)
    pages = letters.select("run_id", F.explode(F.sequence("page_from", "page_to")).alias("page_no"))
    n, page = F.col("field_id"), F.col("page_no")
    faulty = extracted_fields(spark, d).select(
        "field_id", "letter_id",
        F.when(n % 977 == 0, "run-x").otherwise(run).alias("run_id"),
        F.when((n % 967 == 0) & page.isNotNull(), 99).otherwise(page).alias("page_no"),
    )
    return audit.audit_field_sources(faulty, letters, pages)


@query
def j1_party_rules(spark, d):
    """Parties and letters with planted faults: a code given twice, parties of another package, a thread that is not there."""
    held = linked(spark, d)
    parties = bridge.parties(bridge.packages(held.letters))
    again = (F.col("package_id") % 5 == 0) & (F.col("short_code") == "AE")
    parties = parties.withColumn("short_code", F.when(again, "CTR").otherwise(F.col("short_code")))
    p, k = F.col("package_id"), F.col("letter_id")

    def party(code: str, fault: int) -> F.Column:
        number = F.when(F.col(code) == "CTR", 0).when(F.col(code) == "AE", 1).otherwise(2)
        return F.when(k % fault == 0, (p + 1) * 10).otherwise(p * 10 + number)

    letters = held.letters.join(grown(held.components), ["package_id", "letter_id"], "left").select(
        "package_id", "letter_id",
        party("from_code", 211).alias("from_party_id"), party("to_code", 307).alias("to_party_id"),
        F.when((k % 401 == 0) & F.col("component").isNotNull(), -3).otherwise(F.col("component")).alias("thread_id"),
    )
    threads_held = held.summary.select("package_id", F.col("component").alias("thread_id"))
    return audit.audit_parties(parties, letters, threads_held)


@query
def j1_citation_rules(spark, d):
    held = linked(spark, d)
    n = F.col("citing_letter_id")
    faulty = held.citations.withColumns(
        {
            "cited_letter_id": F.when(n % 211 == 0, None).when(n % 307 == 0, -5).otherwise(F.col("cited_letter_id")),
            "resolution_source": F.when(n % 401 == 0, "guess").otherwise(F.col("resolution_source")),
        }
    )
    return audit.audit_citations(faulty, held.letters)


@query
def j1_run_rules(spark, d):
    return audit.audit_runs(_published(spark, d))


@query
def j1_page_rules(spark, d):
    """Pages with planted faults: a page 0, a missing text, a page stored twice."""
    n = F.col("document_id")
    pages = page_ocr(spark, d).select("document_id", "page_no", "text")
    twice = pages.unionByName(pages.where(n % 101 == 0))
    return audit.audit_pages(
        twice.withColumns(
            {
                "page_no": F.when((n % 97 == 0) & (F.col("page_no") == 1), 0).otherwise(F.col("page_no")),
                "text": F.when(n % 89 != 0, F.col("text")),
            }
        )
    )


@query
def j1_void_rules(spark, d):
    k = F.col("letter_id")
    letters = bridged(spark, d).letters.select(
        "letter_id",
        F.when(k % 7 == 0, F.lit("2001-01-01").cast("date")).alias("voided_at"),
        F.when((k % 7 == 0) != (k % 11 == 0), F.lit("misfiled")).alias("void_reason"),
    )
    return audit.audit_voids(letters)


@query
def j1_thread_rules(spark, d):
    held = linked(spark, d)
    c, k = F.col("component"), F.col("letter_id")
    threads = held.summary.select(
        "package_id", "component", F.when(c % 7 == 0, "SAME").otherwise(F.col("thread_key")).alias("thread_key")
    )
    members = held.components.select(
        F.when(k % 53 == 0, -1).otherwise(F.col("package_id")).cast("long").alias("package_id"),
        F.when(k % 61 == 0, -2).otherwise(c).cast("long").alias("component"), "letter_id",
    )
    return audit.audit_threads(threads, members.unionByName(members.where(k % 59 == 0)), held.letters)


@query
def j1_link_table_rules(spark, d):
    held = linked(spark, d)
    n, p = F.col("citing_letter_id"), F.col("package_id")
    offered = held.candidates.withColumn("package_id", F.when(n % 61 == 0, -1).otherwise(p).cast("long"))
    places = held.occurrences
    learned = citations.confirm(held.citations, held.candidates, _confirmations(held))[1]
    moved = learned.withColumn("package_id", F.when(F.col("letter_id") % 3 == 0, -1).otherwise(p).cast("long"))
    return audit.audit_link_tables(
        offered.unionByName(offered.where(n % 67 == 0)), places.unionByName(places.where(n % 71 == 0)), moved, held.letters
    )


@query
def j1_embedding_rules(spark, d):
    vectors = bridge.table(spark, d, "embeddings")
    return audit.audit_embeddings(
        vectors.select(F.floor(F.col("vec_id") / 2).alias("owner_id"), (F.col("vec_id") % 5 != 0).alias("is_current"))
    )


@query
def j2_register_diff(spark, d):
    rows = _live(linked(spark, d)).select("package_id", "serial", "letter_id", "letter_ref", "dated", "thread_key")
    k = F.col("letter_id")
    other = rows.where(k % 333 != 0).withColumns(
        {
            "dated": F.when(k % 77 == 0, F.date_add("dated", 1)).otherwise(F.col("dated")),
            "thread_key": F.when(k % 91 == 0, "OTHER").otherwise(F.col("thread_key")),
        }
    )
    return audit.register_diff(rows, other, ["package_id", "serial"], ["letter_ref", "dated", "thread_key"])


@query
def j2_field_diff(spark, d):
    """Two registers by field: values, validation and pages that differ, and fields on one side only."""
    k = F.col("field_id")
    key = ["package_id", "letter_id", "field_key", "field_index"]
    fields = extracted_fields(spark, d).where("is_current AND letter_id IS NOT NULL")
    rows = fields.select(*key, "field_id", "value", "validation", "page_no")
    other = rows.where(k % 443 != 0).withColumns(
        {
            "value": F.when(k % 101 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")),
            "validation": F.when(k % 131 == 0, "unresolved").otherwise(F.col("validation")),
            "page_no": F.when(k % 131 != 0, F.col("page_no")),
        }
    )
    return audit.register_diff(rows, other, key, ["value", "validation", "page_no"])


@query
def j2_nested_diff(spark, d):
    """Stored claims against a copy in which some documents lost a claim, a box, or moved an end; digests find these."""
    claims = _claims(spark, d).withColumn("claimed", F.col("page"))
    fields = provenance.build_fields(claims, page_ocr(spark, d))
    box = F.concat_ws(",", *[F.round(F.col(f"bbox.union.{c}") * 1e6).cast("long") for c in "xywh"])
    # written once, as a stored register is
    rows = cut_lineage(
        fields.select(
            "document_id", F.col("claimed").alias("page"), "claim_no", "validation", "page_no", "char_start", "char_end",
            F.size("bbox.rects").alias("n_rects"), F.when(F.col("bbox").isNotNull(), box).alias("box"),
        )
    )
    n, claim = F.col("document_id") % 23 == 0, F.col("claim_no")
    other = rows.where(~(n & (claim == 2) & (F.col("page") % 2 == 1))).withColumns(
        {
            "char_end": F.when(n & (claim == 0), F.col("char_end") + 1).otherwise(F.col("char_end")),
            "box": F.when(~(n & (claim == 1)), F.col("box")),
        }
    )
    compared = ["validation", "page_no", "char_start", "char_end", "n_rects", "box"]
    return audit.nested_diff(rows, other, [["document_id"], ["page"], ["claim_no"]], compared)


@query
def j3_version_comparison(spark, d):
    before = extracted_fields(spark, d).select(
        "document_id", F.col("letter_id").alias("candidate"), "field_key", "field_index", "validation",
        F.lit("v1").alias("pipeline_version"),
    )
    after = before.where("candidate % 9 <> 0").withColumns(
        {
            "validation": F.when(F.col("candidate") % 4 == 0, "exact").otherwise(F.col("validation")),
            "pipeline_version": F.lit("v2"),
        }
    )
    return audit.compare_versions(before.unionByName(after), "v1", "v2")


# -- field functions over whole tables


@query
def b_reference_forms(spark, d):
    """B1-B5 on every cited reference."""
    text = F.col("cited_text")
    padded = F.concat(F.lit("  "), F.replace(text, F.lit("/"), F.lit(" / ")), F.lit(" dated 12 "))
    return bridged(spark, d).cited.select(
        "letter_id",
        refs.normalize_ref(padded).alias("normalized"),
        refs.letters_and_digits(text).alias("bare"),
        refs.choose_ref(text, padded).alias("chosen"),
        refs.trailing_serial(text).alias("serial"),
        refs.ref_body(text).alias("body"),
    )


@query
def b_field_values(spark, d):
    """B8-B15 on every letter."""
    k = F.col("letter_id")
    written = (
        F.when(k % 6 == 0, "unknown").when(k % 6 == 1, "2024-02-30").when(k % 6 == 2, F.date_format("od", "dd.MM.yyyy"))
        .otherwise(F.col("od").cast("string"))
    )
    span = fv.parse_chainage_range(F.concat(F.col("chainage"), F.lit(" – Km 7+005")))
    codes = F.array(F.lit("CTR"), F.lit("PD"))
    from_code = fv.party_code(bridge._party_text("from_code"), codes)
    to_code = fv.party_code(bridge._party_text("to_code"), codes)
    return bridged(spark, d).letters.select(
        "letter_id",
        fv.as_date(written).alias("as_date"),
        fv.format_date(F.col("dated")).alias("shown"),
        fv.days_between(F.col("dated"), F.col("received")).alias("days"),
        fv.parse_chainage(F.col("chainage")).alias("metres"),
        span["lo"].alias("lo"), span["hi"].alias("hi"),
        from_code.alias("from_found"), fv.direction(from_code, to_code).alias("direction_found"),
        fv.ranges_overlap(F.col("page_from"), F.col("page_to"), F.lit(2), F.lit(3)).alias("on_two_or_three"),
    )
