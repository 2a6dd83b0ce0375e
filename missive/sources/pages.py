"""Word boxes in: page text with token offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import refs


def assemble_pages(words: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """(document_id, page_no, i, block, par, line, left, top, width, height, conf, text) plus
    page sizes (document_id, page_no, width_px, height_px) -> (document_id, page_no, text, tokens).

    One page is the unit: its words share a window and become one row, as the page is stored.
    """
    page = ["document_id", "page_no"]
    in_order = Window.partitionBy(*page).orderBy("i")
    line = F.struct("block", "par", "line")
    before = F.lag(line).over(in_order)
    text = F.col("text")
    plain = text.rlike("^[!-~]+$")  # ASCII without blanks: nothing to strip or compose
    word = F.when(plain, text).otherwise(refs.nfc(refs.strip_space(text)))
    kept = words.withColumn("word", word).where("word <> ''")
    spaced = kept.withColumn(
        "sep", F.when(before.isNull(), "").when(before == line, " ").otherwise("\n")
    )
    placed = spaced.withColumn(
        "char_end",
        F.sum(F.length("sep") + F.length("word"))
        .over(in_order.rowsBetween(Window.unboundedPreceding, 0))
        .cast("int"),
    )
    token = F.struct(
        "i",
        "sep",
        F.col("word").alias("text"),
        (F.col("char_end") - F.length("word")).alias("char_start"),
        "char_end",
        F.struct(
            (F.col("left") / F.col("width_px")).alias("x"),
            (F.col("top") / F.col("height_px")).alias("y"),
            (F.col("width") / F.col("width_px")).alias("width"),
            (F.col("height") / F.col("height_px")).alias("height"),
        ).alias("bbox"),
        (F.greatest(F.col("conf"), F.lit(0)) / 100.0).alias("confidence"),
    )
    return (
        placed.join(page_sizes, page)
        .groupBy(*page)
        .agg(F.sort_array(F.collect_list(token)).alias("token"))
        .select(
            *page,
            F.array_join(
                F.transform("token", lambda t: F.concat(t.getField("sep"), t.getField("text"))), ""
            ).alias("text"),
            F.transform("token", lambda t: t.dropFields("i", "sep")).alias("tokens"),
        )
    )
