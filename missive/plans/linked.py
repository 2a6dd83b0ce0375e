"""The bridged register as stored tables: letters and citations first, then links and threads.

A register keeps its letters, citations and threads as tables; listings and searches read them
and do not derive or resolve anything again. The tables are written once per session, as
Parquet in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations, threads
from ..session import checkpoint_root, forget, grown, released
from ..sources import pages
from . import bridge

_folders: dict[tuple[str, str, str], str] = {}


class Bridged(NamedTuple):
    letters: DataFrame
    cited: DataFrame


class Linked(NamedTuple):
    letters: DataFrame
    cited: DataFrame
    citations: DataFrame
    scored: DataFrame
    exact: DataFrame
    occurrences: DataFrame
    components: DataFrame
    summary: DataFrame

    @property
    def candidates(self) -> DataFrame:
        return citations.candidate_rows(self.citations, self.scored, self.exact)


def _folder(spark: SparkSession, sf_dir: str, stage: str, fill) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, stage)
    if key not in _folders:
        folder = f"{checkpoint_root(spark)}/{stage}-{uuid.uuid4().hex}"
        with released(spark):
            fill(folder)
        _folders[key] = folder
    return _folders[key]


def _keep(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def bridged(spark: SparkSession, sf_dir: str) -> Bridged:
    def fill(folder: str) -> None:
        letters = _keep(bridge.letters(spark, sf_dir), folder, "letters")
        _keep(bridge.cited(letters), folder, "cited")

    folder = _folder(spark, sf_dir, "bridge", fill)
    return Bridged(*[spark.read.parquet(f"{folder}/{name}") for name in Bridged._fields])


# A bucket of pages holds about so many code points of text.
BUCKET_TEXT = 4_000_000


def page_buckets(spark: SparkSession, sf_dir: str) -> int:
    signs = bridge.table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), signs // BUCKET_TEXT)


def assembled_pages(spark: SparkSession, sf_dir: str, buckets: int) -> DataFrame:
    """Texts move to the bucket of their page before they become words, which take several times the room and move no more."""
    lines = bridge.page_lines(spark, sf_dir)
    words = bridge.words(lines.repartition(buckets, "document_id", "page_no"))
    return pages.assemble_pages(words, grown(bridge.page_sizes(lines)))


def page_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts and tokens as stored after reading, in buckets by page: a join on the page moves the other side only."""

    def fill(folder: str) -> None:
        n = page_buckets(spark, sf_dir)
        stored = assembled_pages(spark, sf_dir, n).write.bucketBy(n, "document_id", "page_no")
        stored.option("path", f"{folder}/pages").saveAsTable(_table_of(folder))

    return spark.table(_table_of(_folder(spark, sf_dir, "pages", fill)))


def _table_of(folder: str) -> str:
    return folder.rsplit("/", 1)[-1].replace("-", "_")


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fill(folder: str) -> None:
        _keep(bridge.fields(*bridged(spark, sf_dir)), folder, "fields")

    return spark.read.parquet(f"{_folder(spark, sf_dir, 'fields', fill)}/fields")


def mentions(letters: DataFrame, cited: DataFrame) -> DataFrame:
    fields = cited.select(
        "package_id", "letter_id", "document_id", "field_index",
        F.col("cited_text").alias("value"), F.col("cited_text").alias("verbatim"),
    )
    return citations.live_mentions(fields, letters)


def linked(spark: SparkSession, sf_dir: str) -> Linked:
    letters, cited = bridged(spark, sf_dir)

    def fill(folder: str) -> None:
        resolved = citations.resolve(mentions(letters, cited), letters)
        links = _keep(resolved.citations, folder, "citations")
        _keep(resolved.scored, folder, "scored")
        _keep(resolved.exact, folder, "exact")
        _keep(resolved.occurrences, folder, "occurrences")
        del resolved
        forget(spark)
        components = _keep(threads.thread_components(letters, links), folder, "components")
        summary = _keep(threads.summarize_threads(letters, components), folder, "summary")
        forget(spark)
        _keep(threads.point_letters(letters, components, summary), folder, "letters")

    folder = _folder(spark, sf_dir, "links", fill)
    stored = {name: spark.read.parquet(f"{folder}/{name}") for name in Linked._fields if name != "cited"}
    return Linked(cited=cited, **stored)
