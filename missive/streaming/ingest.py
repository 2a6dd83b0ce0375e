"""Incremental ingest: extraction files arrive, letters get serials, touched packages are linked and threaded again.

Every change (a micro-batch of files, a set of decisions, a set of voided or superseded letters) reads the buckets of the packages
it touches, and becomes visible at once when it is published; a change that comes again is passed over. Links of touched packages
are recomputed over all their letters: arrival order decides serials, never links. Threads follow from the links that changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import assembly, citations, threads
from ..session import cut_lineage
from ..sources.extraction import parse_extractions
from .store import BUCKETS, Change, Store, Table

ARRIVAL = "package_id BIGINT, document_id STRING, content STRING"

_LINK = (
    "package_id BIGINT, citing_letter_id STRING, cited_ref_normalized STRING, cited_ref_text STRING, "
    "cited_letter_id STRING, resolution STRING, resolution_source STRING, rule STRING"
)
_THREAD = (
    "package_id BIGINT, thread_key STRING, subject STRING, first_dated DATE, last_dated DATE, letter_count BIGINT, "
    "thread_version INT"
)

TABLES = {
    "arrivals": Table("package_id BIGINT, document_id STRING, error STRING, batch BIGINT"),
    "letters": Table(
        "package_id BIGINT, document_id STRING, letter_id STRING, serial BIGINT, letter_ref STRING, "
        "dated DATE, received DATE, subject STRING, from_code STRING, to_code STRING, direction STRING, "
        "page_from INT, page_to INT, is_current BOOLEAN, is_voided BOOLEAN, batch BIGINT"
    ),
    # the latest row of a letter holds
    "letter_states": Table("package_id BIGINT, letter_id STRING, is_current BOOLEAN, is_voided BOOLEAN, decided BIGINT"),
    "fields": Table(
        "package_id BIGINT, document_id STRING, letter_id STRING, field_key STRING, field_index INT, "
        "value STRING, verbatim STRING, page INT"
    ),
    "repeats": Table("package_id BIGINT, document_id STRING, candidate INT, letter_ref STRING, existing_letter_id STRING"),
    "citations": Table(_LINK, replaced=True),
    "scored": Table(
        "package_id BIGINT, citing_letter_id STRING, cited_ref_normalized STRING, "
        "candidate_letter_id STRING, match_method STRING, match_score DOUBLE",
        replaced=True,
    ),
    "exact": Table("package_id BIGINT, cited_ref_normalized STRING, candidate_letter_id STRING", replaced=True),
    "components": Table("package_id BIGINT, letter_id STRING, component STRING", replaced=True),
    "threads": Table(_THREAD, replaced=True),
    # what threads showed, never rewritten
    "thread_versions": Table(f"{_THREAD}, change BIGINT"),
    "memberships": Table("package_id BIGINT, thread_key STRING, thread_version INT, letter_id STRING, change BIGINT"),
    # what people decided, never rewritten
    "decisions": Table(_LINK),
    "aliases": Table("package_id BIGINT, cited_ref_normalized STRING, letter_id STRING, decided BIGINT"),
}


def open_store(spark: SparkSession, store: str) -> Store:
    return Store(spark, store, TABLES)


def create_store(spark: SparkSession, store: str, buckets: int = BUCKETS) -> Store:
    return Store.create(spark, store, TABLES, buckets)


def stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table as last published."""
    return open_store(spark, store).read(name)


def _with_states(letters: DataFrame, states: DataFrame) -> DataFrame:
    """Letters as their latest state shows them."""
    latest = states.groupBy("package_id", "letter_id").agg(
        F.max_by(F.struct("is_current", "is_voided"), "decided").alias("now")
    )
    columns = letters.columns
    return letters.join(latest, ["package_id", "letter_id"], "left").withColumns(
        {c: F.coalesce(f"now.{c}", c) for c in ("is_current", "is_voided")}
    ).select(columns)


def current_letters(spark: SparkSession, store: str) -> DataFrame:
    """Letters with their state and the key of their thread."""
    opened = open_store(spark, store)
    letters = _with_states(opened.read("letters"), opened.read("letter_states"))
    members = opened.read("memberships")
    now = opened.read("threads").where("letter_count > 0")
    shown = members.join(now, ["package_id", "thread_key", "thread_version"], "left_semi").select("package_id", "letter_id", "thread_key")
    return letters.join(shown, ["package_id", "letter_id"], "left")


def current_links(spark: SparkSession, store: str, name: str = "citations") -> DataFrame:
    """Rows each package had when it was last linked (citations, scored, exact, components or threads)."""
    return stored(spark, store, name)


def candidates(spark: SparkSession, store: str) -> DataFrame:
    """All candidates of all citations: a view for reading, ask for single packages or citations."""
    opened = open_store(spark, store)
    return citations.candidate_rows(*(opened.read(name) for name in ("citations", "scored", "exact")))


def _latest_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("package_id", "cited_ref_normalized").agg(
        F.max_by("letter_id", F.struct("decided", "letter_id")).alias("letter_id")
    )


def _link_and_thread(change: Change) -> None:
    """Links, threads and their versions of the touched packages, from their letters, fields and decisions."""
    letters = cut_lineage(_with_states(change.read("letters"), change.read("letter_states")))
    cited = change.read("fields").where("field_key = 'cited_ref'")
    links_before = change.read("citations").where("resolution = 'resolved'").select(
        "package_id", F.col("citing_letter_id").alias("src"), F.col("cited_letter_id").alias("dst")
    )
    components_before, threads_before = change.read("components"), change.read("threads")
    resolved = citations.resolve(
        citations.live_mentions(cited, letters), letters, _latest_aliases(change.read("aliases"))
    )
    decided = change.read("decisions")
    undecided = resolved.citations.join(decided, citations.CITATION, "left_anti")
    links = change.replace("citations", undecided.unionByName(decided))
    change.replace("scored", resolved.scored)
    change.replace("exact", resolved.exact)
    components = change.replace(
        "components", threads.updated_components(components_before, links_before, letters, links)
    )
    summary = cut_lineage(threads.summarize_threads(letters, components))
    # a thread without letters keeps its row, with a count of zero
    now = change.replace("threads", threads.upsert_threads(threads_before, summary))
    number = F.lit(change.store.version + 1)
    fresh = now.join(threads_before, threads_before.columns, "left_anti")
    change.append("thread_versions", fresh.withColumn("change", number))
    members = threads.memberships(now, summary, components)
    change.append("memberships", members.withColumn("change", number))


def record_confirmations(spark: SparkSession, store: str, confirmations: DataFrame, number: int) -> DataFrame:
    """Stores the valid ones of `confirmations` as set `number` -> the rejected ones.

    The packages of the confirmations are linked again with the aliases these teach, and threaded again. Only the candidates
    asked for are looked up. A set that is in the store already is left as it is, and nothing is rejected.
    """
    opened = open_store(spark, store)
    batch = f"decisions-{number:012d}"
    change = Change(opened, batch, confirmations)
    current = change.read("citations").join(confirmations.select(*citations.CITATION).distinct(), citations.CITATION, "left_semi")
    offered = citations.asked_candidates(confirmations, current, change.read("scored"), change.read("exact"))
    current = cut_lineage(current)
    linked, aliases, rejected = citations.confirm(current, cut_lineage(offered), confirmations)
    if batch in opened.published:
        return rejected.limit(0)
    rejected = cut_lineage(rejected)
    fresh = linked.where("resolution_source = 'human'").join(
        current.where("resolution_source = 'human'"), citations.CITATION, "left_anti"
    )
    change.append("aliases", aliases.withColumn("decided", F.lit(number).cast("long")))
    change.append("decisions", fresh)
    _link_and_thread(change)
    change.publish()
    return rejected


def record_states(spark: SparkSession, store: str, states: DataFrame, number: int) -> None:
    """Voided, superseded or revived letters (package_id, letter_id, is_current, is_voided) as set `number`.

    Serials stay with their letters. A set that is in the store already is passed over.
    """
    opened = open_store(spark, store)
    batch = f"states-{number:012d}"
    if batch in opened.published:
        return
    change = Change(opened, batch, states)
    # sets follow one another in the order they are published
    change.append("letter_states", states.withColumn("decided", F.lit(opened.version + 1).cast("long")))
    _link_and_thread(change)
    change.publish()


def letter_id() -> Column:
    return F.sha2(F.concat_ws("|", "package_id", "document_id", "candidate"), 256)


def ingest_batch(arrived: DataFrame, batch: int, store: str, parties: DataFrame) -> None:
    spark = arrived.sparkSession
    opened = open_store(spark, store)
    name = f"files-{batch:012d}"
    if name in opened.published:
        return
    key = ["package_id", "document_id"]
    change = Change(opened, name, arrived)
    read_already = change.read("arrivals").where("error IS NULL").select(*key)
    fresh = cut_lineage(
        arrived.groupBy(*key).agg(F.min("content").alias("content")).join(read_already, key, "left_anti")
    )
    parsed = parse_extractions(fresh)
    number = F.lit(batch).cast("long")
    held = _with_states(change.read("letters"), change.read("letter_states")).drop("batch")
    change.append("arrivals", fresh.join(parsed.errors, key, "left").withColumn("batch", number))
    filled, _ = assembly.split_blank(parsed.candidates)
    merged = assembly.merge_existing(filled, held)
    counters = change.packages.join(
        held.groupBy("package_id").agg(F.max("serial").alias("last")), "package_id", "left"
    ).select("package_id", (F.coalesce("last", F.lit(0)) + 1).alias("next_serial"))
    numbered, _ = assembly.assign_serials(assembly.resolve_parties(merged.fresh, parties), counters)
    change.append(
        "letters",
        numbered.withColumns(
            {"letter_id": letter_id(), "is_current": F.lit(True), "is_voided": F.lit(False), "batch": number}
        ),
    )
    change.append("repeats", merged.repeats)
    kept = merged.fresh.select(*key, "candidate", letter_id().alias("letter_id"))
    change.append("fields", parsed.fields.join(kept, [*key, "candidate"], "left"))
    _link_and_thread(change)
    change.publish()


def start_ingest(
    spark: SparkSession,
    source: str,
    store: str,
    checkpoint: str,
    parties: DataFrame,
    files_per_batch: int = 1000,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Reads everything that has arrived, in micro-batches, and stops; run again for later files."""
    create_store(spark, store, buckets)
    arrived = (
        spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).json(source)
    )
    return (
        arrived.writeStream.foreachBatch(lambda df, batch: ingest_batch(df, batch, store, parties))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
