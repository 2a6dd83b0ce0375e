"""Correspondence tables derived from the given parquet tables.

The same rules as SQL are in `oracles.BRIDGE`; here they are DataFrames, and the two places
that need order inside a group use the cell-wise operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import number_rows, previous_in_order
from ..session import grown
from ..sources.intake import raster_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _party(k: F.Column) -> F.Column:
    return F.when(k % 3 == 0, "CTR").when(k % 3 == 1, "AE").otherwise("PD")


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register letters: one per order, packages of sixty customers."""
    orders = table(spark, sf_dir, "orders")
    customer = grown(table(spark, sf_dir, "customer"))
    base = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("o_orderkey").alias("letter_id"),
        F.col("o_custkey").alias("cust"),
        F.floor(F.col("o_custkey") / 60).cast("long").alias("package_id"),
        F.col("o_orderdate").cast("date").alias("od"),
        F.col("o_orderpriority").alias("prio"),
        F.col("c_mktsegment").alias("seg"),
    )
    k = F.col("letter_id")
    code = _party(k)
    point = F.concat(
        F.lit("Km "), (k % 90).cast("string"), F.lit("+"),
        F.lpad(((k * 37) % 1000).cast("string"), 3, "0"),
    )
    ref = F.concat(
        code, F.lit("/PKG"), F.col("package_id").cast("string"), F.lit("/"),
        F.year("od").cast("string"), F.lit("/"), F.lpad(k.cast("string"), 7, "0"),
    )
    return number_rows(base, ["package_id"], "letter_id", "serial").select(
        "letter_id", "cust", "package_id", "od", "serial",
        code.alias("from_code"),
        F.when(k % 3 != 0, "CTR").when(k % 2 == 0, "AE").otherwise("PD").alias("to_code"),
        F.when(k % 3 == 0, "outward").otherwise("inward").alias("direction"),
        F.when(k % 97 != 0, F.col("od")).alias("dated"),
        F.when(k % 5 != 0, F.date_add("od", 3)).alias("received"),
        ref.alias("letter_ref"),
        F.concat("prio", F.lit(" "), F.lower("seg"), F.lit(": shifting of box culvert")).alias("subject"),
        F.when(k % 7 == 1, "km 12.4").when(k % 7 != 0, point).alias("chainage"),
        F.when(k % 4 == 0, "Cl. 10.3.2").when(k % 4 == 1, "Cl. 17.3").alias("clause"),
        F.when(k % 11 == 3, "needs_review").when(k % 11 == 4, "verified")
        .otherwise("unverified").alias("review_status"),
        F.concat(F.lit("DOC"), (k - k % 3).cast("string")).alias("document_id"),
        (k % 3 + 1).cast("int").alias("page_from"),
        (k % 3 + 1 + k % 2).cast("int").alias("page_to"),
        (k % 53 != 0).alias("is_current"),
        (k % 59 == 0).alias("is_voided"),
    )


def cited(letters: DataFrame) -> DataFrame:
    """Each letter cites the same customer's previous one, the reference damaged by rule."""
    k, t = F.col("letter_id"), F.col("_prev.letter_ref")
    text = (
        F.when(k % 10 <= 4, t)
        .when(k % 10 == 5, F.replace(t, F.lit("/"), F.lit("-")))
        .when(k % 10 == 6, F.concat(F.lit("No. "), F.lower(t)))
        .when(k % 10 == 7, F.replace(t, F.lit("PKG"), F.lit("PK6")))
        .when(k % 10 == 8, F.concat(F.lit("ZZ/NOTHELD/"), F.lpad(k.cast("string"), 7, "9")))
        .otherwise(F.concat(F.substring(t, F.lit(1), F.length(t) - 2), F.lit("99")))
    )
    slim = letters.select("letter_id", "package_id", "document_id", "cust", "od", "letter_ref")
    return (
        previous_in_order(slim, ["cust"], "od", "letter_id", ["letter_ref"], "_prev")
        .where(t.isNotNull() & (k % 11 != 0))
        .select(
            "letter_id", "package_id", "document_id", F.lit(0).alias("field_index"),
            text.alias("cited_text"),
        )
    )


CLAIMS_A_PAGE = 3


def page_claims(page_ocr: DataFrame) -> DataFrame:
    """Quotes claimed to stand on every assembled page, from places all over its text; a fifth each exact, with doubled blanks,
    absent, with line breaks for blanks, empty."""
    n = F.col("document_id") * 7919 + F.col("page_no") * 104_729 + F.col("claim_no") * 15_485_863
    at = (1 + (n % 1_000_003) % F.greatest(F.length("text") - 20, F.lit(1))).cast("int")
    kind = F.floor((n % 1_000_003) / 7) % 5
    quote = (
        F.when(kind == 0, F.substring("text", at, F.lit(20)))
        .when(kind == 1, F.replace(F.substring("text", at, F.lit(20)), F.lit(" "), F.lit("  ")))
        .when(kind == 2, "ZZZ not there")
        .when(kind == 3, F.replace(F.substring("text", at, F.lit(30)), F.lit(" "), F.lit("\n")))
        .otherwise("")
    )
    claims = page_ocr.withColumn("claim_no", F.explode(F.sequence(F.lit(0), F.lit(CLAIMS_A_PAGE - 1))))
    return claims.select("document_id", F.col("page_no").alias("page"), "claim_no", quote.alias("verbatim"))


# Positions of the fields of a letter in its field ids.
FIELD_KEYS = [
    "letter_ref", "dated", "received", "from_party", "to_party", "subject", "chainage", "clause", "cited_ref",
]


def _party_text(code: str) -> F.Column:
    return (
        F.when(F.col(code) == "CTR", "M/s Contractor")
        .when(F.col(code) == "AE", "Authority Engineer")
        .otherwise("Project Director")
    )


def fields(letters: DataFrame, cited: DataFrame) -> DataFrame:
    """Extracted fields of every letter; states follow from the letter number by rule."""
    with_cited = letters.join(grown(cited).select("letter_id", "cited_text"), "letter_id", "left")
    values = [
        F.col("letter_ref"), F.col("dated").cast("string"), F.col("received").cast("string"),
        _party_text("from_code"), _party_text("to_code"), F.col("subject"),
        F.col("chainage"), F.col("clause"), F.col("cited_text"),
    ]
    entries = F.array(
        *[F.struct(F.lit(i).alias("pos"), F.lit(k).alias("field_key"), v.alias("value"))
          for i, (k, v) in enumerate(zip(FIELD_KEYS, values))]
    )
    k, pos = F.col("letter_id"), F.col("f.pos")
    missed = (k * 7 + pos) % 23 == 0
    return (
        with_cited.select("package_id", "letter_id", "document_id", "page_from", F.explode(entries).alias("f"))
        .where("f.value IS NOT NULL")
        .select(
            (k * 100 + pos).alias("field_id"), "package_id", "letter_id", "document_id",
            F.col("f.field_key").alias("field_key"), F.lit(0).alias("field_index"),
            F.col("f.value").alias("value"), F.col("f.value").alias("verbatim"),
            F.when(~missed, F.col("page_from")).alias("page_no"),
            F.when(missed, "unresolved").when((k + pos) % 5 == 0, "normalized_exact").otherwise("exact")
            .alias("validation"),
            F.when((k + pos * 3) % 19 == 0, "verified").otherwise("unreviewed").alias("review_status"),
            ((k + pos) % 31 != 0).alias("is_current"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: one per line item, several may belong to a run."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"),
        F.col("l_orderkey").alias("letter_id"),
        F.col("l_linenumber").alias("attempt"),
        F.col("l_shipdate").cast("date").alias("started_at"),
        F.col("l_quantity").cast("long").alias("input_tokens"),
        F.col("l_suppkey").cast("long").alias("output_tokens"),
    )


def runs(spark: SparkSession, sf_dir: str, letters: DataFrame) -> DataFrame:
    """Extraction runs of the document of each letter, some failed, some with drifted totals."""
    k, n = F.col("letter_id"), F.col("attempt")
    failed = (k + n) % 4 == 0
    return (
        requests(spark, sf_dir)
        .groupBy("run_id", "letter_id", "attempt")
        .agg(
            F.min("started_at").alias("started_at"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
        )
        .join(grown(letters).select("letter_id", "package_id", "document_id"), "letter_id")
        .select(
            "run_id", "package_id", "document_id",
            F.concat(F.lit("v"), (n % 3 + 1).cast("string")).alias("pipeline_version"),
            F.when(failed, "failed").otherwise("succeeded").alias("status"),
            F.when(failed, "no answer").alias("error"),
            "started_at",
            F.when(F.col("run_id") % 41 != 0, F.date_add("started_at", 1)).alias("finished_at"),
            (F.col("input_tokens") + (k % 13 == 0).cast("int")).alias("input_tokens"),
            "output_tokens",
        )
    )


def filings(letters: DataFrame) -> DataFrame:
    return letters.select("package_id", "document_id").distinct()


def documents(letters: DataFrame) -> DataFrame:
    n = F.substring("document_id", 4, 20).cast("long")
    return letters.select("document_id").distinct().select(
        "document_id",
        F.concat("document_id", F.lit(".pdf")).alias("original_filename"),
        (n * 7 + 100).alias("byte_size"),
        F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int")).alias("ingested_at"),
    )


def document_pages(letters: DataFrame) -> DataFrame:
    """Page images, some documents rendered under two versions."""
    last = letters.groupBy("document_id").agg(F.max("page_to").alias("last"))
    n = F.substring("document_id", 4, 20).cast("long")
    versions = F.when(n % 2 == 0, F.array(F.lit("v1"), F.lit("v2"))).otherwise(F.array(F.lit("v1")))
    return (
        last.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.col("last"))))
        .withColumn("pipeline_version", F.explode(versions))
        .select(
            "document_id", "page_no", "pipeline_version",
            raster_key(F.col("pipeline_version"), F.sha2("document_id", 256), F.col("page_no")).alias("raster_uri"),
        )
    )


def packages(letters: DataFrame) -> DataFrame:
    p = F.col("package_id")
    return letters.select("package_id").distinct().select(
        "package_id",
        F.concat(F.lit("Highway PKG-"), p.cast("string")).alias("name"),
        F.concat(F.lit("C/PKG"), p.cast("string"), F.lit("/1995")).alias("contract_no"),
        (p % 10).alias("owner_user_id"),
        F.lit(1).cast("long").alias("next_serial"),
        F.when(p % 2 == 0, "^(CTR|AE|PD)/PKG[0-9]+/[0-9]{4}/[0-9]+$").alias("ref_pattern"),
        F.lit("1995-06-01").cast("date").alias("starts_on"),
        F.lit("2001-01-31").cast("date").alias("ends_on"),
    )


def parties(packages: DataFrame) -> DataFrame:
    codes = F.array(F.lit("CTR"), F.lit("AE"), F.lit("PD"))
    return packages.select("package_id", F.posexplode(codes).alias("n", "short_code")).select(
        "package_id", (F.col("package_id") * 10 + F.col("n")).alias("party_id"), "short_code"
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work sections: one stretch of road per supplier, in the package of its nation number."""
    lo = (F.col("s_suppkey") * 137) % 88000
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("long").alias("package_id"), F.col("s_suppkey").alias("section_id"),
        lo.alias("lo"), (lo + 1500).alias("hi"),
    )


LINES_A_PAGE = 20


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every document text, of up to 20 lines at line breaks."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n").alias("lines"))
    # a null text has no page
    numbers = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / LINES_A_PAGE).cast("int"))
    cut = F.transform(numbers, lambda p: F.slice("lines", p * LINES_A_PAGE + 1, F.lit(LINES_A_PAGE)))
    return lines.where("lines IS NOT NULL").select("document_id", F.posexplode(cut).alias("p", "lines")).select(
        "document_id", (F.col("p") + 1).alias("page_no"), "lines"
    )


def words(lines: DataFrame) -> DataFrame:
    """Word boxes of every page: words at blanks."""
    placed = lines.select("document_id", "page_no", F.posexplode("lines").alias("at", "line_text")).select(
        "document_id", "page_no", ((F.col("page_no") - 1) * LINES_A_PAGE + F.col("at")).alias("line_no"), "line_text"
    )
    return placed.select(
        "document_id", "page_no", "line_no", F.posexplode(F.split("line_text", " ")).alias("word_no", "text")
    ).select(
        "document_id", "page_no",
        (F.col("line_no").cast("long") * 100000 + F.col("word_no")).alias("i"),
        F.lit(1).alias("block"), F.lit(1).alias("par"), F.col("line_no").alias("line"),
        (F.col("word_no") * 60).alias("left"), (F.col("line_no") % LINES_A_PAGE * 40).alias("top"),
        (F.length("text") * 8).alias("width"), F.lit(30).alias("height"),
        ((F.col("line_no") * 31 + F.col("word_no") * 7) % 102 - 1).cast("double").alias("conf"),
        "text",
    )


def page_sizes(lines: DataFrame) -> DataFrame:
    return lines.select("document_id", "page_no", F.lit(1000).alias("width_px"), F.lit(2000).alias("height_px"))


def extraction_files(letters: DataFrame, cited: DataFrame) -> DataFrame:
    """One JSON answer per filed document, up to three letters each; one in a hundred is cut off."""

    def field(value: F.Column) -> F.Column:
        return F.when(
            value.isNotNull(), F.struct(value.alias("value"), value.alias("verbatim"), F.col("page_from").alias("page"))
        )

    def listed(value: F.Column) -> F.Column:
        return F.array_compact(F.array(field(value)))

    letter = F.struct(
        "page_from", "page_to",
        field(F.col("letter_ref")).alias("letter_ref"),
        field(F.coalesce(F.col("dated").cast("string"), F.lit("null"))).alias("dated"),
        field(F.col("received").cast("string")).alias("received"),
        field(_party_text("from_code")).alias("from_party"),
        field(_party_text("to_code")).alias("to_party"),
        field(F.col("subject")).alias("subject"),
        listed(F.col("chainage")).alias("chainage"),
        listed(F.col("clause")).alias("clause"),
        listed(F.col("cited_text")).alias("cited_refs"),
    )
    # a document is three consecutive letter numbers, so its list has at most three entries
    content = F.to_json(
        F.struct(
            F.transform(
                F.sort_array(F.collect_list(F.struct("letter_id", letter.alias("letter")))),
                lambda e: e.getField("letter"),
            ).alias("letters")
        )
    )
    return (
        letters.join(grown(cited).select("letter_id", "cited_text"), "letter_id", "left")
        # plain rows move, lists of structures are built where they arrive
        .repartition("package_id", "document_id")
        .groupBy("package_id", "document_id")
        .agg(content.alias("content"))
        .withColumn(
            "content",
            F.when(
                F.substring("document_id", 4, 20).cast("long") % 100 == 0, F.substring("content", 1, 40)
            ).otherwise(F.col("content")),
        )
    )
