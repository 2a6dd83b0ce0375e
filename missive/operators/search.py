"""Filters, chronology, keyword search, suggestions and vector search over register rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fields import format_date, parse_chainage, search_words, suggestion_text
from ..functions.refs import strip_space
from ..session import cut_lineage
from .ordering import previous_in_order
from .ranges import overlap_pairs

# Vectors a search compares at once: queries of a lot, vectors that give bounds, vectors that split blocks.
QUERY_LOT = 32_768
SEEDS = 2048
PIVOTS = 32

# Words that never become suggestions.
STOPWORDS = [
    "the", "of", "and", "for", "to", "in", "on", "at", "a", "an", "is", "are",
    "as", "with", "from", "by", "or", "be", "it", "its", "this", "that", "under", "into",
    "reg", "sub", "ref", "dated", "sir", "madam", "please", "shall", "may", "no",
]


def filter_register(
    rows: DataFrame,
    date_from: str | None = None,
    date_to: str | None = None,
    chainage_from: int | None = None,
    chainage_to: int | None = None,
    direction: str | None = None,
    counterparty: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Conjunction of the filters that are set; rows that lack a filtered value fall out."""
    if date_from:
        rows = rows.where(F.col("dated") >= F.lit(date_from).cast("date"))
    if date_to:
        rows = rows.where(F.col("dated") <= F.lit(date_to).cast("date"))
    if chainage_from is not None:
        rows = rows.where(parse_chainage(F.col("chainage")) >= chainage_from)
    if chainage_to is not None:
        rows = rows.where(parse_chainage(F.col("chainage")) <= chainage_to)
    if direction:
        rows = rows.where(F.col("direction") == direction)
    if counterparty:
        rows = rows.where((F.col("from_code") == counterparty) | (F.col("to_code") == counterparty))
    if status:
        rows = rows.where(F.col("review_status") == status)
    return rows


def on_chainage(ranges: DataFrame, lo: int, hi: int) -> DataFrame:
    """Ranges that overlap [lo, hi]."""
    return ranges.where((F.col("lo") <= hi) & (F.col("hi") >= lo))


def chainage_overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one package with overlapping ranges, each once, however long the ranges are.

    `left` (package_id, letter_id, lo, hi), `right` (package_id, section_id, lo, hi).
    """
    sections = right.withColumnsRenamed({"lo": "section_lo", "hi": "section_hi"})
    return overlap_pairs(left, sections, ["package_id"], ("lo", "hi"), ("section_lo", "section_hi")).select(
        "package_id", "letter_id", "section_id", "lo", "hi", "section_lo", "section_hi"
    )


def on_clause(letters: DataFrame, letter_clauses: DataFrame, clause: str) -> DataFrame:
    wanted = letter_clauses.where(F.col("clause") == clause)
    return letters.join(wanted, ["package_id", "letter_id"], "left_semi")


def chronological(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("dated").asc_nulls_last(), "serial")


def thread_gaps(rows: DataFrame) -> DataFrame:
    """Days from the letter before in its thread, with both endpoints; undated letters come last.

    A letter without thread key has no letter before it and a row without gap.
    """
    placed = previous_in_order(
        rows.where("thread_key IS NOT NULL"), ["package_id", "thread_key"], "dated", "serial", ["letter_ref", "dated"], "_prev"
    )
    alone = rows.where("thread_key IS NULL").withColumn("_prev", F.lit(None).cast(placed.schema["_prev"].dataType))
    placed = placed.unionByName(alone)
    return placed.select(
        "package_id", "thread_key", "letter_id", "serial",
        F.col("_prev.letter_ref").alias("gap_from_ref"),
        F.col("_prev.dated").alias("gap_from_dated"),
        F.col("letter_ref").alias("gap_to_ref"),
        F.col("dated").alias("gap_to_dated"),
        F.datediff("dated", F.col("_prev.dated")).alias("gap_days"),
    )


def thread_spans(rows: DataFrame) -> DataFrame:
    """First and last dated letter of each thread and the days between."""
    dated = F.when(F.col("dated").isNotNull(), F.struct("dated", "serial"))
    return rows.groupBy("package_id", "thread_key").agg(
        F.min_by("letter_ref", dated).alias("first_ref"),
        F.min("dated").alias("first_dated"),
        F.max_by("letter_ref", dated).alias("last_ref"),
        F.max("dated").alias("last_dated"),
        F.datediff(F.max("dated"), F.min("dated")).alias("span_days"),
        F.count("*").alias("letter_count"),
    )


def package_summary(rows: DataFrame, packages: DataFrame, query: str) -> DataFrame:
    """Figures of the packages whose name or contract number contains the query or is in it."""
    wanted = query.strip().lower()

    def touches(name: str) -> Column:
        text = F.lower(strip_space(F.col(name)))
        return text.contains(wanted) | F.contains(F.lit(wanted), text)

    named = packages.where(touches("name") | touches("contract_no")) if wanted else packages.where("false")
    return (
        rows.join(named.select("package_id", "name"), "package_id")
        .groupBy("package_id", "name")
        .agg(
            F.count("*").alias("letter_count"),
            F.count_if(F.col("review_status") == "needs_review").alias("needs_review_count"),
            F.countDistinct("thread_key").alias("thread_count"),
            F.datediff(F.max("dated"), F.min("dated")).alias("span_days"),
        )
    )


def keyword_search(rows: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Letters in which every word of the query occurs, best first, with the fields that matched."""
    phrase = query.strip().lower()
    words = phrase.split()
    named = {
        "letter ref": F.col("letter_ref"),
        "subject": F.col("subject"),
        "chainage": F.col("chainage"),
        "clause": F.col("clause"),
        "parties": F.concat_ws(" ", "from_code", "to_code"),
        "dated": format_date(F.col("dated")),
        "thread": F.col("thread_key"),
        "source file": F.col("original_filename"),
    }
    texts = {name: F.lower(strip_space(F.coalesce(text, F.lit("")))) for name, text in named.items()}

    def any_of(parts: list[Column]) -> Column:
        result = F.lit(False)
        for part in parts:
            result = result | part
        return result

    hits = rows.where(F.lit(bool(words)))
    for word in words:
        hits = hits.where(any_of([text.contains(word) for text in texts.values()]))
    matched = F.array_compact(
        F.array(
            *[
                F.when(any_of([text.contains(w) for w in words]), F.lit(name))
                for name, text in texts.items()
            ]
        )
    )
    ranked = hits.select(
        "package_id", "letter_id", "serial",
        F.array_join(matched, ", ").alias("matched_on"),
        F.size(matched).alias("matched_n"),
        any_of([text.contains(phrase) for text in texts.values()]).alias("phrase_hit"),
    ).orderBy(F.col("phrase_hit").desc(), F.col("matched_n").desc(), "serial", "package_id")
    return ranked.limit(limit) if limit else ranked


def suggestion_index(rows: DataFrame) -> DataFrame:
    """(package_id, kind, text, letters): every word, phrase and identifier a search can hit.

    The first spelling met in serial order is kept. Counting starts before the shuffle, so words
    found in every subject cost one row per task.
    """
    words = search_words(F.col("subject"))
    paired = F.transform(
        F.sequence(F.lit(1), F.size("_words")),
        lambda i: F.struct(
            F.element_at("_words", i).alias("word"), F.get("_words", i).alias("following")
        ),
    )
    usable = F.filter(paired, lambda p: ~p.getField("word").isin(STOPWORDS))
    singles = F.transform(usable, lambda p: suggestion_text(p.getField("word")))
    followed = F.filter(
        usable, lambda p: p.getField("following").isNotNull() & ~p.getField("following").isin(STOPWORDS)
    )
    pairs = F.transform(
        followed, lambda p: suggestion_text(F.concat(p.getField("word"), F.lit(" "), p.getField("following")))
    )

    def entry(kind: str, text: Column, place: int) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), F.lit(place).alias("place"))

    entries = F.concat(
        F.array(
            entry("ref", F.col("letter_ref"), 0),
            entry("chainage", F.col("chainage"), 1),
            entry("clause", F.col("clause"), 2),
            entry("file", F.col("original_filename"), 3),
            entry("thread", F.col("thread_key"), 4),
            entry("party", F.col("from_code"), 5),
            entry("party", F.col("to_code"), 6),
        ),
        F.transform(F.when(F.size("_words") > 0, F.concat(singles, pairs)).otherwise(F.array()),
                    lambda t: entry("subject", t, 7)),
    )
    text = strip_space(F.col("e.text"))
    return (
        rows.withColumn("_words", F.coalesce(words, F.array()))
        .select("package_id", "serial", F.explode(entries).alias("e"))
        .select("package_id", "serial", "e.kind", "e.place", text.alias("text"))
        .where(F.length("text") >= 2)
        .groupBy("package_id", "kind", F.lower("text").alias("key"))
        .agg(
            F.min_by("text", F.struct("serial", "place", "text")).alias("text"), F.count("*").alias("count")
        )
        .select("package_id", "kind", "text", "count")
    )


def match_suggestions(index: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Of each package the best suggestions that begin with the query, or contain a word that does."""
    wanted = query.strip().lower()
    text = F.lower("text")
    rank = F.when(text.startswith(wanted), 0).when(
        F.exists(F.split(text, r"[\s/_-]+"), lambda w: w.startswith(wanted)), 1
    )
    by_rank = Window.partitionBy("package_id").orderBy("rank", F.col("count").desc(), F.length("text"), "text", "kind")
    return (
        index.where(F.lit(len(wanted) >= 2))
        .where(text != wanted)
        .withColumn("rank", rank)
        .where("rank IS NOT NULL")
        .withColumn("place", F.row_number().over(by_rank))
        .where(F.col("place") <= limit)
        .drop("place")
    )


def completions(index: DataFrame, longest: int = 4, limit: int = 8) -> DataFrame:
    """(package_id, prefix, place, kind, text, count, rank): the best suggestions of every prefix of two to `longest` signs.

    One aggregation over the suggestion index, kept as a table; `complete` looks many queries up in it with one join. Each entry
    has at most its own few prefixes; a prefix that very many entries share is cut to `limit` per task before the shuffle.
    """
    text = F.lower("text")
    lengths = F.sequence(F.lit(2), F.lit(longest))

    def prefixes(of: Column) -> Column:
        return F.transform(lengths, lambda n: F.when(F.length(of) >= n, F.substr(of, F.lit(1), n)))

    def typed(found: Column) -> Column:
        # a query is stripped and is never the whole suggestion
        kept = F.filter(found, lambda p: p.isNotNull() & (strip_space(p) == p) & (p != text))
        return F.array_distinct(kept)

    words = F.flatten(F.transform(F.split(text, r"[\s/_-]+"), prefixes))
    entries = F.concat(
        F.transform("_first", lambda p: F.struct(p.alias("prefix"), F.lit(0).alias("rank"))),
        F.transform(F.array_except("_inner", "_first"), lambda p: F.struct(p.alias("prefix"), F.lit(1).alias("rank"))),
    )
    by_rank = Window.partitionBy("package_id", "prefix").orderBy("rank", F.col("count").desc(), F.length("text"), "text", "kind")
    return (
        index.where("text IS NOT NULL")
        .withColumns({"_first": typed(prefixes(text)), "_inner": typed(words)})
        .select("package_id", "kind", "text", "count", F.explode(entries).alias("e"))
        .select("package_id", "e.prefix", "kind", "text", "count", "e.rank")
        .withColumn("place", F.row_number().over(by_rank))
        .where(F.col("place") <= limit)
    )


def complete(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The suggestions of each ask (package_id, query) from a table of completions; longer and one-sign queries have none here."""
    wanted = asked.select("package_id", "query", F.lower(strip_space(F.col("query"))).alias("prefix"))
    return wanted.join(table, ["package_id", "prefix"]).drop("prefix")


def _unit_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and vector as doubles of those that have a direction: no missing or not finite entry, not all zero."""
    whole = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", whole.alias("v")).where(usable & F.exists("v", lambda x: x != 0))


def semantic_nearest(embeddings: DataFrame, queries: DataFrame, k: int, lot: int = QUERY_LOT) -> DataFrame:
    """The k embeddings closest to each query vector by cosine, equal ones by number; marked as not authoritative.

    `embeddings` and `queries` have vec_id and embedding, of one length. Queries are taken in lots of bounded size, each of which
    is scored in blocks against every vector in one pass; a task hands on its best k of each query. Before that, each query gets
    a bound: its k-th best among a fixed number of vectors. The vectors of a block are split among pivots, and a query skips
    those whose angle to their pivot differs from its own by more than its bound allows (triangle inequality of angles), so
    nothing is lost. Vectors without direction are neither found nor asked for.
    """
    vectors, asked = _unit_vectors(embeddings), _unit_vectors(queries)
    # the lowest hashes: the same vectors at every run, at most SEEDS of them
    seeds = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEEDS).collect()
    if not seeds:
        return embeddings.sparkSession.createDataFrame(
            [], "query_id long, vec_id long, similarity double, rank int, authoritative boolean"
        )

    def unit(rows: list) -> np.ndarray:
        matrix = np.array(rows, dtype=np.float64)
        return matrix / np.linalg.norm(matrix, axis=1)[:, None]

    known = unit([r.v for r in seeds])
    pivots = known[:PIVOTS]
    lots = max(1, -(-asked.count() // lot))
    numbered = cut_lineage(asked.withColumn("lot", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(lots))))
    best = None
    for number in range(lots):
        # about `lot` queries of one vector each, whatever the number of vectors
        part = numbered.where(F.col("lot") == number).collect()
        if not part:
            continue
        ids, wanted = np.array([r.vec_id for r in part], dtype=np.int64), unit([r.v for r in part])
        angles = np.arccos(np.clip(wanted @ pivots.T, -1, 1))
        reached = np.sort(wanted @ known.T, axis=1)[:, -k] if len(known) >= k else np.full(len(part), -1.0)
        # ranks go by rounded similarity
        bound = reached - 2e-6

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = batch.column(0).to_numpy(zero_copy_only=False)
                rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1)
                rows = rows / np.linalg.norm(rows, axis=1)[:, None]
                to_pivots = rows @ pivots.T
                cell = to_pivots.argmax(axis=1)
                found = []
                for c in np.unique(cell):
                    own = np.flatnonzero(cell == c)
                    angle = np.arccos(np.clip(to_pivots[own, c], -1, 1))
                    gap = np.maximum(0, np.maximum(angles[:, c] - angle.max(), angle.min() - angles[:, c]))
                    open_ = np.flatnonzero(np.cos(gap) >= bound)
                    similarity = np.round(wanted[open_] @ rows[own].T, 6)
                    q, v = np.nonzero(similarity >= bound[open_][:, None])
                    found.append((open_[q], numbers[own[v]], similarity[q, v]))
                q, v, similarity = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((v, -similarity, q))
                q, v, similarity = q[order], v[order], similarity[order]
                first = np.searchsorted(q, q, side="left")
                top = np.arange(len(q)) - first < k
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[q[top]]), pa.array(v[top]), pa.array(similarity[top])], ["query_id", "vec_id", "similarity"]
                )

        scored = vectors.mapInArrow(score, "query_id long, vec_id long, similarity double")
        best = scored if best is None else best.unionByName(scored)
    by_rank = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    best = best if best is not None else vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0.0).alias("similarity")).limit(0)
    return (
        best.withColumn("rank", F.row_number().over(by_rank))
        .where(F.col("rank") <= k)
        .withColumn("authoritative", F.lit(False))
    )
