"""Extraction answers in: JSON to candidate letters and fields, and page texts as one bundle."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs
from ..functions.fields import as_date
from ..schemas import EXTRACTION, LIST_KEYS, SCALAR_KEYS


class Parsed(NamedTuple):
    candidates: DataFrame
    fields: DataFrame
    errors: DataFrame


def _blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def parse_extractions(raw: DataFrame) -> Parsed:
    """`raw` has (package_id, document_id, content).

    -> candidate letters (one per array entry), fields (one per object that says anything, lists numbered from 0), and the
    documents whose content could not be read. An answer without letters is read and has none.
    """
    schema = EXTRACTION.removesuffix(">") + ", _broken: STRING>"
    options = {"columnNameOfCorruptRecord": "_broken"}
    read = raw.select("package_id", "document_id", F.from_json("content", schema, options).alias("doc"))
    broken = read.where("doc IS NULL OR (doc.letters IS NULL AND doc._broken IS NOT NULL)")
    errors = broken.select("package_id", "document_id", F.lit("unreadable extraction").alias("error"))
    entries = read.where("doc.letters IS NOT NULL").select(
        "package_id", "document_id", F.posexplode("doc.letters").alias("candidate", "letter")
    )
    letter_ref = refs.choose_ref(F.col("letter.letter_ref.value"), F.col("letter.letter_ref.verbatim"))
    candidates = entries.select(
        "package_id",
        "document_id",
        "candidate",
        letter_ref.alias("letter_ref"),
        _blank_to_null(refs.normalize_ref(letter_ref)).alias("letter_ref_normalized"),
        as_date(F.col("letter.dated.value")).alias("dated"),
        as_date(F.col("letter.received.value")).alias("received"),
        F.col("letter.subject.value").alias("subject"),
        F.col("letter.from_party.value").alias("from_text"),
        F.col("letter.to_party.value").alias("to_text"),
        F.coalesce("letter.page_from", F.lit(1)).alias("page_from"),
        F.coalesce("letter.page_to", F.lit(1)).alias("page_to"),
    )

    def one(key: str, index: Column, item: Column) -> Column:
        return F.struct(
            F.lit(key).alias("field_key"),
            index.alias("field_index"),
            item.getField("value").alias("value"),
            item.getField("verbatim").alias("verbatim"),
            item.getField("page").alias("page"),
        )

    def says_anything(item: Column) -> Column:
        return F.coalesce(*[item.getField(k).cast("string") for k in ("value", "verbatim", "page")]).isNotNull()

    def numbered(name: str, key: str) -> Column:
        items = F.coalesce(F.col(f"letter.{name}"), F.array())
        return F.transform(items, lambda item, i: F.when(says_anything(item), one(key, i, item)))

    scalars = F.array(
        *[F.when(says_anything(F.col(f"letter.{k}")), one(k, F.lit(0), F.col(f"letter.{k}"))) for k in SCALAR_KEYS]
    )
    every = F.concat(scalars, *[numbered(name, key) for name, key in LIST_KEYS.items()])
    fields = entries.select(
        "package_id", "document_id", "candidate", F.explode(F.array_compact(every)).alias("field")
    ).select("package_id", "document_id", "candidate", "field.*")
    return Parsed(candidates, fields, errors)


def bundle_pages(page_ocr: DataFrame) -> DataFrame:
    """Page texts of one document in page order under '--- PAGE n ---' headings."""
    pages = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    headed = F.transform(
        pages,
        lambda p: F.concat(
            F.lit("--- PAGE "), p.getField("page_no").cast("string"), F.lit(" ---\n"), p.getField("text")
        ),
    )
    return page_ocr.groupBy("document_id").agg(F.array_join(headed, "\n\n").alias("bundle"))
