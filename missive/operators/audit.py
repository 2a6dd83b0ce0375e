"""Rules of the data model as queries: each violation is a row (rule, table, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..session import cut_lineage


def _rows(df: DataFrame, bad: Column, rule: str, table: str, key: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select(
        F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), key.cast("string").alias("key")
    )


def _one_of(name: str, allowed: list[str]) -> Column:
    return F.col(name).isNotNull() & ~F.col(name).isin(allowed)


def _repeated(df: DataFrame, keys: list[str], rule: str, table: str) -> DataFrame:
    return (
        df.groupBy(*keys)
        .count()
        .where("count > 1")
        .select(F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), F.concat_ws("/", *keys).alias("key"))
    )


def _orphans(df: DataFrame, parent: DataFrame, keys: dict[str, str], rule: str, table: str, key: Column) -> DataFrame:
    """Rows whose non-null keys find no parent; parent columns are the values of `keys`."""
    wanted = parent.select(*[F.col(v).alias(k) for k, v in keys.items()]).distinct()
    filled = df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return filled.join(wanted, list(keys), "left_anti").select(
        F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), key.cast("string").alias("key")
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def audit_letters(letters: DataFrame) -> DataFrame:
    key = F.col("letter_id")
    return _all(
        [
            _rows(letters, F.col("page_from") > F.col("page_to"), "page_from <= page_to", "letters", key),
            _rows(letters, _one_of("review_status", schemas.REVIEW_STATUS), "review_status known", "letters", key),
            _rows(letters, _one_of("direction", schemas.DIRECTION), "direction known", "letters", key),
            _repeated(letters.where("is_current"), ["package_id", "serial"], "one current letter per serial", "letters"),
        ]
    )


def audit_fields(fields: DataFrame, letters: DataFrame) -> DataFrame:
    key = F.col("field_id")
    placed = F.col("validation").isin("exact", "normalized_exact")
    return _all(
        [
            _rows(fields, _one_of("validation", schemas.VALIDATION), "validation known", "fields", key),
            _rows(fields, _one_of("review_status", schemas.FIELD_REVIEW), "review_status known", "fields", key),
            _rows(
                fields,
                (F.col("validation") == "unresolved") & F.col("page_no").isNotNull(),
                "unresolved fields have no geometry", "fields", key,
            ),
            _rows(fields, placed & F.col("page_no").isNull(), "located fields have geometry", "fields", key),
            _repeated(
                fields.where("is_current AND letter_id IS NOT NULL"),
                ["letter_id", "field_key", "field_index"], "one current field per place", "fields",
            ),
            _orphans(
                fields, letters, {"package_id": "package_id", "letter_id": "letter_id"},
                "field belongs to a letter of its package", "fields", key,
            ),
        ]
    )


def audit_geometry(fields: DataFrame, key: Column) -> DataFrame:
    """Offsets and boxes of stored fields: all of them for a located value, none for an unresolved one."""
    located = F.col("validation").isin("exact", "normalized_exact")
    place = [F.col(c).isNull() for c in ("bbox", "char_start", "char_end", "page_no")]
    broken = {
        "unresolved fields have no box or offset": (F.col("validation") == "unresolved") & ~(place[0] & place[1]),
        "located fields have box, offsets and page": located & (place[0] | place[1] | place[2] | place[3]),
        "end behind start": located & (F.col("char_end") <= F.col("char_start")),
    }
    rules = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in broken.items()]))
    # one pass for all rules; the list in a list keeps Spark from testing its size first, which would place every field again
    found = fields.select(key.cast("string").alias("key"), F.explode(F.array(rules)).alias("rules"))
    return found.select(F.explode("rules").alias("rule"), F.lit("fields").alias("table_name"), "key")


def audit_field_sources(fields: DataFrame, letters: DataFrame, pages: DataFrame) -> DataFrame:
    """Fields (field_id, run_id, letter_id, page_no) against the letters and the read pages of their own run."""
    key = F.col("field_id")
    return _all(
        [
            _orphans(
                fields, letters, {"letter_id": "letter_id", "run_id": "run_id"},
                "field and letter from one run", "fields", key,
            ),
            _orphans(fields, pages, {"run_id": "run_id", "page_no": "page_no"}, "field on a page of its run", "fields", key),
        ]
    )


def audit_parties(parties: DataFrame, letters: DataFrame, threads: DataFrame) -> DataFrame:
    """Parties of a package, and the parties and thread of a letter, which belong to the letter's own package."""
    key, own = F.col("letter_id"), {"package_id": "package_id"}
    return _all(
        [
            _repeated(parties, ["package_id", "short_code"], "one party per short code", "parties"),
            *[
                _orphans(letters, parties, {**own, f"{side}_party_id": "party_id"}, f"{side} party of the package", "letters", key)
                for side in ("from", "to")
            ],
            _orphans(letters, threads, {**own, "thread_id": "thread_id"}, "thread of the package", "letters", key),
        ]
    )


def audit_citations(citations: DataFrame, letters: DataFrame) -> DataFrame:
    key = F.concat_ws("/", "citing_letter_id", "cited_ref_normalized")
    resolved = F.col("resolution") == "resolved"
    ends = {"package_id": "package_id"}
    return _all(
        [
            _rows(citations, resolved != F.col("cited_letter_id").isNotNull(), "resolved means linked", "citations", key),
            _rows(citations, _one_of("resolution", schemas.RESOLUTION), "resolution known", "citations", key),
            _rows(citations, _one_of("resolution_source", schemas.SOURCE), "source known", "citations", key),
            _repeated(citations, ["citing_letter_id", "cited_ref_normalized"], "one citation per reference", "citations"),
            _orphans(
                citations, letters, {**ends, "citing_letter_id": "letter_id"},
                "citing letter in the same package", "citations", key,
            ),
            _orphans(
                citations, letters, {**ends, "cited_letter_id": "letter_id"},
                "cited letter in the same package", "citations", key,
            ),
        ]
    )


def audit_runs(runs: DataFrame) -> DataFrame:
    key = F.col("run_id")
    ended = F.col("status").isin("succeeded", "failed", "superseded")
    return _all(
        [
            _rows(runs, _one_of("status", schemas.RUN_STATUS), "status known", "runs", key),
            _rows(runs, ended != F.col("finished_at").isNotNull(), "ended runs have an end", "runs", key),
            _rows(runs, F.col("is_current") & (F.col("status") != "succeeded"), "current runs succeeded", "runs", key),
            _repeated(runs.where("is_current"), ["package_id", "document_id"], "one current run per document", "runs"),
        ]
    )


def audit_pages(pages: DataFrame) -> DataFrame:
    key = F.concat_ws("/", "document_id", "page_no")
    return _all(
        [
            _rows(pages, F.col("page_no") < 1, "page_no from 1", "pages", key),
            _rows(pages, F.col("text").isNull(), "page has a text", "pages", key),
            _repeated(pages, ["document_id", "page_no"], "one row per document page", "pages"),
        ]
    )


def audit_voids(letters: DataFrame) -> DataFrame:
    uneven = F.col("voided_at").isNull() != F.col("void_reason").isNull()
    return _rows(letters, uneven, "void date and reason together", "letters", F.col("letter_id"))


def audit_threads(threads: DataFrame, members: DataFrame, letters: DataFrame) -> DataFrame:
    """`threads` (package_id, component, thread_key), `members` (package_id, component, letter_id)."""
    key = F.concat_ws("/", "component", "letter_id")
    return _all(
        [
            _repeated(threads, ["package_id", "thread_key"], "one thread per key", "threads"),
            _repeated(members, ["letter_id"], "one thread per letter", "memberships"),
            _orphans(
                members, threads, {"package_id": "package_id", "component": "component"},
                "member of a thread of its package", "memberships", key,
            ),
            _orphans(
                members, letters, {"package_id": "package_id", "letter_id": "letter_id"},
                "member is a letter of its package", "memberships", key,
            ),
        ]
    )


def audit_link_tables(
    candidates: DataFrame, occurrences: DataFrame, aliases: DataFrame, letters: DataFrame
) -> DataFrame:
    candidate = F.concat_ws("/", "citing_letter_id", "cited_ref_normalized", "candidate_letter_id")
    alias = F.concat_ws("/", "package_id", "cited_ref_normalized")
    return _all(
        [
            _repeated(
                candidates, ["citing_letter_id", "cited_ref_normalized", "candidate_letter_id"],
                "one row per candidate", "candidates",
            ),
            _orphans(
                candidates, letters, {"package_id": "package_id", "candidate_letter_id": "letter_id"},
                "candidate in the same package", "candidates", candidate,
            ),
            _repeated(
                occurrences, ["citing_letter_id", "cited_ref_normalized", "field_index"],
                "one row per occurrence", "occurrences",
            ),
            _repeated(aliases, ["package_id", "cited_ref_normalized"], "one alias per reference", "aliases"),
            _orphans(
                aliases, letters, {"package_id": "package_id", "letter_id": "letter_id"},
                "alias in the same package", "aliases", alias,
            ),
        ]
    )


def audit_embeddings(embeddings: DataFrame) -> DataFrame:
    """`embeddings` (owner_id, is_current)."""
    return _repeated(embeddings.where("is_current"), ["owner_id"], "one current embedding", "embeddings")


def register_diff(left: DataFrame, right: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Differences between two registers, one row per key and column.

    Rows on one side only have the column '*'. Null equals null.
    """
    a = left.select(*keys, F.struct(*compared).alias("_a"))
    b = right.select(*keys, F.struct(*compared).alias("_b"))
    both = a.join(b, keys, "full_outer")
    one_sided = F.when(
        F.col("_a").isNull() | F.col("_b").isNull(),
        F.array(
            F.struct(
                F.lit("*").alias("column_name"),
                F.when(F.col("_a").isNotNull(), "present").alias("left_value"),
                F.when(F.col("_b").isNotNull(), "present").alias("right_value"),
            )
        ),
    )
    per_column = F.array_compact(
        F.array(
            *[
                F.when(
                    ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")),
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(f"_a.{c}").cast("string").alias("left_value"),
                        F.col(f"_b.{c}").cast("string").alias("right_value"),
                    ),
                )
                for c in compared
            ]
        )
    )
    return both.select(*keys, F.explode(F.coalesce(one_sided, per_column)).alias("d")).select(*keys, "d.*")


def nested_diff(left: DataFrame, right: DataFrame, levels: list[list[str]], compared: list[str]) -> DataFrame:
    """`register_diff` over the keys of all levels, where only groups with different digests are compared.

    `levels` are key columns from the outermost group inward (package, letter, field); together they are the key of a row. A
    digest is the row count and two sums of hashes of the written-out rows, added up before the shuffle; two different groups
    have equal digests about once in 2^128. Each level compares digests only inside groups that differed one level up, and
    the rows themselves move only for the innermost groups that differ. A key must not be null.
    """
    keys = [k for level in levels for k in level]
    written = F.to_json(F.struct(*keys, *compared), {"ignoreNullFields": "false"})

    def digest(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        sums = [F.sum(F.xxhash64(F.lit(n), "_row").cast("decimal(20,0)")) for n in (1, 2)]
        return rows.withColumn("_row", written).groupBy(*by).agg(F.struct(F.count("*"), *sums).alias(name))

    sides = [left.select(*keys, *compared), right.select(*keys, *compared)]
    for depth in range(1, len(levels)):
        by = [k for level in levels[:depth] for k in level]
        a, b = digest(sides[0], by, "_a"), digest(sides[1], by, "_b")
        differing = cut_lineage(a.join(b, by, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*by))
        sides = [rows.join(differing, by, "left_semi") for rows in sides]
    return register_diff(*sides, keys, compared)


def compare_versions(fields: DataFrame, old: str, new: str) -> DataFrame:
    """Shift of validation states between two pipeline versions of the same fields."""
    keys = ["document_id", "candidate", "field_key", "field_index"]

    def under(version: str, name: str) -> DataFrame:
        return fields.where(F.col("pipeline_version") == version).select(*keys, F.col("validation").alias(name))

    joined = under(old, "was").join(under(new, "now"), keys, "full_outer")
    states = ["exact", "normalized_exact", "unresolved"]
    return (
        joined.withColumn("was", F.coalesce("was", F.lit("absent")))
        .groupBy("field_key", "was")
        .agg(
            *[F.count_if(F.col("now") == s).alias(f"now_{s}") for s in states],
            F.count_if(F.col("now").isNull()).alias("now_absent"),
        )
    )
