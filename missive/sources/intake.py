"""Files in: content hashes, duplicate classes, storage keys, integrity, upload outcome, table sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Originals under a folder as (path, modificationTime, length, content)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )


def intake(files: DataFrame, mime_type: str = "application/pdf") -> DataFrame:
    """(path, content) -> the immutable identity of each file, where its original belongs, its size."""
    sha = F.sha2("content", 256)
    return files.select(
        F.col("path"),
        sha.alias("sha256"),
        F.octet_length("content").cast("long").alias("byte_size"),
        F.lit(mime_type).alias("mime_type"),
        F.element_at(F.split("path", "/"), -1).alias("original_filename"),
        original_key(sha).alias("storage_uri"),
    )


def original_key(sha256: Column) -> Column:
    return F.concat(F.lit("documents/"), F.substring(sha256, 1, 2), F.lit("/"), sha256)


def raster_key(version: Column, sha256: Column, page_no: Column) -> Column:
    return F.concat(
        F.lit("derived/"), version, F.lit("/"), sha256,
        F.format_string("/page-%03d.png", page_no.cast("int")),
    )


def classify_intake(
    arrivals: DataFrame, documents: DataFrame, filings: DataFrame, current_runs: DataFrame
) -> DataFrame:
    """Outcome per arrival: duplicate, reprocess, linked or new.

    `arrivals` has (package_id, sha256, arrival). First arrivals are minima, taken before the
    shuffle, so thousands of copies of one file meet in no single group.
    """
    first_any = arrivals.groupBy("sha256").agg(F.min("arrival").alias("first_any"))
    first_here = arrivals.groupBy("package_id", "sha256").agg(F.min("arrival").alias("first_here"))
    known = documents.select("sha256", F.lit(True).alias("known")).distinct()
    filed = filings.select("package_id", "sha256", F.lit(True).alias("filed")).distinct()
    done = current_runs.select("package_id", "sha256", F.lit(True).alias("done")).distinct()
    return (
        arrivals.join(first_here, ["package_id", "sha256"])
        .join(first_any, "sha256")
        .join(known, "sha256", "left")
        .join(filed, ["package_id", "sha256"], "left")
        .join(done, ["package_id", "sha256"], "left")
        .withColumn(
            "outcome",
            F.when(F.col("done") | (F.col("arrival") > F.col("first_here")), "duplicate")
            .when(F.col("filed"), "reprocess")
            .when(F.col("known") | (F.col("arrival") > F.col("first_any")), "linked")
            .otherwise("new"),
        )
        .drop("first_any", "first_here", "known", "filed", "done")
    )


def rows_to_insert(classified: DataFrame, documents: DataFrame, filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new document hashes, new filings); each is written once however often it arrived."""
    new_documents = classified.select("sha256").distinct().join(documents, "sha256", "left_anti")
    new_filings = (
        classified.select("package_id", "sha256")
        .distinct()
        .join(filings, ["package_id", "sha256"], "left_anti")
    )
    return new_documents, new_filings


def audit_integrity(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Stored bytes against recorded identity; `documents` (sha256), `files` (key, content)."""
    expected = documents.select("sha256", original_key(F.col("sha256")).alias("key"))
    actual = files.select("key", F.sha2("content", 256).alias("actual"))
    return expected.join(actual, "key", "full_outer").select(
        "key",
        "sha256",
        F.when(F.col("sha256").isNull(), "unregistered")
        .when(F.col("actual").isNull(), "missing")
        .when(F.col("actual") == F.col("sha256"), "intact")
        .otherwise("altered")
        .alias("state"),
    )


def upload_report(classified: DataFrame, letters: DataFrame, merged: DataFrame, errors: DataFrame) -> DataFrame:
    """What came of each document of a package: outcome, letters found, references merged, error."""
    key = ["package_id", "sha256"]
    found = letters.groupBy(*key).agg(F.count("*").alias("letters_found"))
    joined = merged.groupBy(*key).agg(
        F.count("*").alias("merged"), F.min("letter_ref").alias("first_merged_ref")
    )
    failed = errors.groupBy(*key).agg(F.min("error").alias("error"))
    first = classified.groupBy(*key).agg(
        F.min_by("outcome", "arrival").alias("outcome"), F.count("*").alias("arrivals")
    )
    return (
        first.join(found, key, "left")
        .join(joined, key, "left")
        .join(failed, key, "left")
        .select(
            *key,
            "arrivals",
            (F.col("outcome") == "duplicate").alias("is_duplicate"),
            F.coalesce("letters_found", F.lit(0)).alias("letters_found"),
            F.coalesce("merged", F.lit(0)).alias("merged"),
            "first_merged_ref",
            "error",
        )
    )


def merged_references(classified: DataFrame, merged: DataFrame) -> DataFrame:
    """Each reference of an upload that joined a letter held before, one row per document and reference."""
    uploads = classified.select("package_id", "sha256").distinct()
    return (
        merged.join(uploads, ["package_id", "sha256"], "left_semi")
        .groupBy("package_id", "sha256", "letter_ref")
        .agg(F.count("*").alias("merged"))
    )


def save(df: DataFrame, path: str, version: int) -> str:
    """One snapshot per version, split by package; a rerun replaces only its own version.

    Rows are brought together by package first, so a package has one file, or several of a good size if it is large.
    """
    target = f"{path}/version={version}"
    df.hint("rebalance", "package_id").write.mode("overwrite").partitionBy("package_id").parquet(target)
    return target


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")
