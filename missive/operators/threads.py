"""Threads: connected components of resolved citations, their summaries and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import refs
from ..session import cut_lineage, forget, grown


def _is_star_forest(edges: DataFrame) -> bool:
    """Every child has one parent and no parent is a child."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent"))
    )
    per_node = ends.groupBy("x").agg(F.sum("child").alias("child"), F.sum("parent").alias("parent"))
    return per_node.where("child > 1 OR (child = 1 AND parent > 0)").isEmpty()


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for every node of `nodes(id)`; component is the smallest id reached.

    Alternating large-star and small-star rounds: rounds grow with the logarithm of the
    longest chain, and a hub costs one minimum per task before the shuffle. Each round is
    checkpointed, so lineage stays short and a lost executor repeats one round at most.
    """
    linked = cut_lineage(
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    while not _is_star_forest(linked):
        both = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(grown(smallest), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(grown(lowest), "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.withColumnRenamed("m", "v"))
            .distinct()
        )
        linked = cut_lineage(small)
        # what the round before kept is not read again
        del both, smallest, large, lowest, small
        forget(linked.sparkSession)
    parent = linked.select(F.col("u").alias("id"), F.col("v").alias("parent"))
    return nodes.join(grown(parent), "id", "left").select("id", F.coalesce("parent", "id").alias("component"))


def live_links(letters: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live letters, and resolved links with both ends live."""
    live = letters.where("is_current AND NOT is_voided").select("package_id", "letter_id")
    links = citations.where("resolution = 'resolved'").select(
        "package_id", F.col("citing_letter_id").alias("src"), F.col("cited_letter_id").alias("dst")
    )
    for end in ("src", "dst"):
        links = links.join(grown(live).select("package_id", F.col("letter_id").alias(end)), ["package_id", end], "left_semi")
    return live, links.distinct()


def thread_components(letters: DataFrame, citations: DataFrame) -> DataFrame:
    """(package_id, letter_id, component) of live letters over links with both ends live."""
    live, links = live_links(letters, citations)
    found = connected_components(live.select(F.col("letter_id").alias("id")), links.select("src", "dst"))
    return grown(live).join(found.withColumnRenamed("id", "letter_id"), "letter_id").select(
        "package_id", "letter_id", "component"
    )


def updated_components(components: DataFrame, links_before: DataFrame, letters: DataFrame, citations: DataFrame) -> DataFrame:
    """Components after a change of letters or links, equal to `thread_components(letters, citations)`.

    `components` (package_id, letter_id, component) and `links_before` (package_id, src, dst) are those from before the change.
    A component that lost a link or a letter may have fallen apart: its letters start on their own again. All others start as
    one node each, so old links inside them vanish, and the rounds run over the links of what changed alone.
    """
    live, links = map(cut_lineage, live_links(letters, citations))
    live, links, components = grown(live), grown(links), grown(components)
    gone = components.join(live, ["package_id", "letter_id"], "left_anti").select("package_id", "letter_id")
    lost = links_before.join(links, ["package_id", "src", "dst"], "left_anti")
    ends = lost.select("package_id", F.explode(F.array("src", "dst")).alias("letter_id"))
    broken = components.join(gone.unionByName(ends).distinct(), ["package_id", "letter_id"], "left_semi")
    broken = broken.select("package_id", "component").distinct()
    whole = components.join(broken, ["package_id", "component"], "left_anti")
    start = grown(
        cut_lineage(
            live.join(whole, ["package_id", "letter_id"], "left").select(
                "package_id", "letter_id", F.coalesce("component", "letter_id").alias("node")
            )
        )
    )
    edges = links
    for end in ("src", "dst"):
        named = start.select("package_id", F.col("letter_id").alias(end), F.col("node").alias(f"{end}_node"))
        edges = edges.join(named, ["package_id", end])
    edges = edges.where("src_node <> dst_node").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"))
    met = connected_components(start.select(F.col("node").alias("id")).distinct(), edges)
    return start.join(met.withColumnRenamed("id", "node"), "node").select("package_id", "letter_id", "component")


def summarize_threads(letters: DataFrame, components: DataFrame) -> DataFrame:
    """One row per component: key and subject of the earliest letter, dates, size.

    Two components of a package with the same key are told apart by the component id.
    """
    order = F.struct(F.col("dated").isNull(), "dated", "serial")
    key = F.coalesce(
        F.nullif(refs.normalize_ref(F.col("letter_ref")), F.lit("")),
        "letter_ref",
        F.col("letter_id").cast("string"),
    )
    summary = (
        letters.join(grown(components), ["package_id", "letter_id"])
        .withColumn("key", key)
        .groupBy("package_id", "component")
        .agg(
            F.min_by(F.struct("key", "subject"), order).alias("first"),
            F.min("dated").alias("first_dated"),
            F.max("dated").alias("last_dated"),
            F.count("*").alias("letter_count"),
        )
        .select(
            "package_id", "component", "first.key", "first.subject",
            "first_dated", "last_dated", "letter_count",
        )
    )
    shared = summary.groupBy("package_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    return grown(summary).join(shared, ["package_id", "key"], "left").select(
        "package_id",
        "component",
        F.when(F.col("n").isNull(), F.col("key"))
        .otherwise(F.concat("key", F.lit("#"), F.col("component").cast("string")))
        .alias("thread_key"),
        "subject", "first_dated", "last_dated", "letter_count",
    )


def upsert_threads(stored: DataFrame, summary: DataFrame) -> DataFrame:
    """Stored threads after a recompute: known keys get the next version and keep their subject,
    new keys start at version 1, threads without members keep their row with a count of 0."""
    both = stored.alias("old").join(grown(summary).alias("new"), ["package_id", "thread_key"], "full_outer")
    gone = F.col("new.letter_count").isNull()
    return both.select(
        "package_id",
        "thread_key",
        F.coalesce("old.subject", "new.subject").alias("subject"),
        F.when(gone, F.col("old.first_dated")).otherwise(F.col("new.first_dated")).alias("first_dated"),
        F.when(gone, F.col("old.last_dated")).otherwise(F.col("new.last_dated")).alias("last_dated"),
        F.coalesce("new.letter_count", F.lit(0)).alias("letter_count"),
        F.when(gone, F.col("old.thread_version"))
        .otherwise(F.coalesce("old.thread_version", F.lit(0)) + 1)
        .alias("thread_version"),
    )


def memberships(threads: DataFrame, summary: DataFrame, components: DataFrame) -> DataFrame:
    """Rows to append to the membership log: (package, thread, version, letter)."""
    return (
        components.join(grown(summary).select("package_id", "component", "thread_key"), ["package_id", "component"])
        .join(grown(threads).select("package_id", "thread_key", "thread_version"), ["package_id", "thread_key"])
        .select("package_id", "thread_key", "thread_version", "letter_id")
    )


def point_letters(letters: DataFrame, components: DataFrame, summary: DataFrame) -> DataFrame:
    """Letters with the key of their thread."""
    keys = components.join(
        grown(summary).select("package_id", "component", "thread_key"), ["package_id", "component"]
    ).drop("component")
    return letters.join(grown(keys), ["package_id", "letter_id"], "left")


def threads_as_of(log: DataFrame, version: int) -> DataFrame:
    """Members each thread showed at its last version up to `version`."""
    shown = (
        log.where(F.col("thread_version") <= version)
        .groupBy("package_id", "thread_key")
        .agg(F.max("thread_version").alias("thread_version"))
    )
    return log.join(grown(shown), ["package_id", "thread_key", "thread_version"], "left_semi")


def thread_of_letter(pointed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Letters sharing a thread with each wanted letter, oldest first, undated last."""
    threads = (
        pointed.join(wanted, ["package_id", "letter_id"], "left_semi")
        .select("package_id", "thread_key")
        .distinct()
    )
    return pointed.join(threads, ["package_id", "thread_key"], "left_semi").orderBy(
        "package_id", "thread_key", F.col("dated").asc_nulls_last(), "serial"
    )
