"""Where a quoted value stands in its page: offsets, rectangles, and the token audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import refs


def _words_pattern(verbatim: Column) -> Column:
    """Regular expression for the quote with any whitespace run between its words."""
    literal = F.replace(refs.collapse_space(verbatim), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    gap = F.lit(f"\\E{refs.SPACE}+\\Q")
    return F.concat(F.lit("\\Q"), F.replace(literal, F.lit(" "), gap), F.lit("\\E"))


def _once(value: Column, use) -> Column:
    """`use` of a value that is worked out once however often it is used; in a conditional branch Spark would do it anew each time."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, verbatim: Column) -> Column:
    """STRUCT<validation, char_start, char_end> in code points.

    The whitespace-blind pass runs only on rows the exact search missed. The first occurrence
    of the string the pattern matched is the match itself, so `locate` yields its offset.
    """
    exact = F.position(verbatim, text)

    def loose(page: Column) -> Column:
        usable = (refs.collapse_space(verbatim) != "") & (F.length(page) == F.length(text))
        return F.when(usable, F.call_function("regexp_extract", page, _words_pattern(refs.nfc(verbatim)), F.lit(0)))

    def result(kind: str, start: Column, length: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("validation"),
            start.cast("int").alias("char_start"),
            (start + length).cast("int").alias("char_end"),
        )

    nothing = F.lit(None).cast("int")
    return (
        F.when(F.coalesce(verbatim, F.lit("")) == "", result("unresolved", nothing, nothing))
        .when(exact > 0, result("exact", exact - 1, F.length(verbatim)))
        .otherwise(
            _once(
                refs.nfc(text),
                lambda page: _once(
                    loose(page),
                    lambda found: F.when(
                        found != "", result("normalized_exact", F.position(found, page) - 1, F.length(found))
                    ).otherwise(result("unresolved", nothing, nothing)),
                ),
            )
        )
    )


def boxes(tokens: Column, start: Column, end: Column) -> Column:
    """STRUCT<union, rects> over the tokens a span touches, null when it touches none."""
    touched = F.filter(
        tokens, lambda t: (t.getField("char_start") < end) & (t.getField("char_end") > start)
    )
    rects = F.transform(
        touched,
        lambda t: F.struct(
            t.getField("bbox").getField("x").alias("x"),
            t.getField("bbox").getField("y").alias("y"),
            t.getField("bbox").getField("width").alias("w"),
            t.getField("bbox").getField("height").alias("h"),
        ),
    )

    def around(rects: Column) -> Column:
        def edge(pick, low: str, extent: str | None = None) -> Column:
            return pick(
                F.transform(
                    rects,
                    lambda r: r.getField(low) + r.getField(extent) if extent else r.getField(low),
                )
            )

        left, top = edge(F.array_min, "x"), edge(F.array_min, "y")
        union = F.struct(
            left.alias("x"),
            top.alias("y"),
            (edge(F.array_max, "x", "w") - left).alias("w"),
            (edge(F.array_max, "y", "h") - top).alias("h"),
        )
        return F.when(F.size(rects) > 0, F.struct(union.alias("union"), rects.alias("rects")))

    return _once(rects, around)


def locate_verbatim(fields: DataFrame, page_ocr: DataFrame) -> DataFrame:
    """Fields with validation and offsets; a page that was never read leaves them unresolved.

    A plain join on (document, page): the page text is read in the row that joined and is not
    shuffled once per field.
    """
    pages = page_ocr.select("document_id", F.col("page_no").alias("page"), F.col("text").alias("_text"))
    found = located(F.col("_text"), F.col("verbatim"))
    return (
        fields.join(pages, ["document_id", "page"], "left")
        .withColumn("_found", found)
        .withColumns(
            {
                "validation": F.coalesce("_found.validation", F.lit("unresolved")),
                "char_start": F.col("_found.char_start"),
                "char_end": F.col("_found.char_end"),
            }
        )
        .drop("_text", "_found")
    )


def map_spans(located_fields: DataFrame, page_ocr: DataFrame) -> DataFrame:
    """Located fields with the rectangles of the tokens they touch."""
    pages = page_ocr.select("document_id", F.col("page_no").alias("page"), F.col("tokens").alias("_tokens"))
    return (
        located_fields.join(pages, ["document_id", "page"], "left")
        .withColumn("bbox", boxes(F.col("_tokens"), F.col("char_start"), F.col("char_end")))
        .drop("_tokens")
    )


def build_fields(fields: DataFrame, page_ocr: DataFrame) -> DataFrame:
    """Fields as stored: located, boxed, and without geometry or page unless both succeeded."""
    pages = page_ocr.select(
        "document_id", F.col("page_no").alias("page"),
        F.col("text").alias("_text"), F.col("tokens").alias("_tokens"),
    )
    placed = (
        fields.join(pages, ["document_id", "page"], "left")
        .withColumn("_found", located(F.col("_text"), F.col("verbatim")))
        .withColumn("_box", boxes(F.col("_tokens"), F.col("_found.char_start"), F.col("_found.char_end")))
    )
    held = F.col("_box").isNotNull()
    return placed.withColumns(
        {
            "validation": F.when(held, F.col("_found.validation")).otherwise("unresolved"),
            "char_start": F.when(held, F.col("_found.char_start")),
            "char_end": F.when(held, F.col("_found.char_end")),
            "page_no": F.when(held, F.col("page")),
            "bbox": F.col("_box"),
        }
    ).drop("_text", "_tokens", "_found", "_box", "page")


def _between(text: str, parts: Column, width: Column, start: Column, length: Column) -> Column:
    """Part of a text, looked up in overlapping parts of it: from its begin on, each would take time that grows with its place."""
    near = (start >= 0) & (length <= width) & (start < F.size(parts) * width)
    part = F.get(parts, F.floor(start / width).cast("int"))
    return F.when(near, F.substring(part, (start % width + 1).cast("int"), length)).otherwise(F.substring(F.col(text), start + 1, length))


def audit_tokens(page_ocr: DataFrame) -> DataFrame:
    """Tokens whose text is not the page text at their offsets."""
    # parts as wide as keeps cutting them and looking into them about equal
    width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.length("text") * 6))).cast("int")
    numbers = F.sequence(F.lit(0), F.floor(F.length("text") / width).cast("int"))
    parts = F.transform(numbers, lambda k: F.substring(F.col("text"), k * width + 1, width * 2))

    def beside(cut: Column):
        def one(token: Column, number: Column) -> Column:
            length = token["char_end"] - token["char_start"]
            return F.struct(
                number.alias("token_no"),
                token["text"].alias("expected"),
                _between("text", cut["parts"], cut["width"], token["char_start"], length).alias("actual"),
            )

        return one

    # the page text is not copied to its tokens: only the wrong ones leave the array
    wrong = F.transform(
        F.array(F.struct(parts.alias("parts"), width.alias("width"))),
        lambda cut: F.filter(F.transform("tokens", beside(cut)), lambda t: t["actual"] != t["expected"]),
    )[0]
    # worked out once: Spark would filter by the array's size before it explodes it
    found = page_ocr.select("document_id", "page_no", F.explode(F.array(wrong)).alias("wrong"))
    return found.select("document_id", "page_no", F.explode("wrong").alias("t")).select("document_id", "page_no", "t.*")
