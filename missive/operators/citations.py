"""Citation resolution: exact, punctuation-blind, confirmed alias, trigram candidates,
serial-anchored; everything else is flagged or recorded as missing.

Every join carries the package, so no link can cross packages. The held side of the exact
rules is reduced to one row per reference before the join: a reference cited by a third of
all letters meets one row, not a group.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import refs
from ..session import cut_lineage, grown

# Fixed values of the matching rules.
MIN_SIMILARITY = 0.5
BEST = 3
MIN_BODY_RATIO = 0.6

# A reference's own bound comes from references that share one of so many rarest used grams, which at most so many use.
PROBE_GRAMS = 4
PROBE_USES = 256

# A gram used by more references of a package than this is split for the join, into as many parts as its uses ask for.
PART_SIZE = 512

# Packages of up to so many letters and citations are compared whole, each in one task; larger ones are joined by grams.
WHOLE = 16384
# Scores of a package worked out at once, and rows of a task.
CELLS = 1 << 17
TASK_ROWS = 100_000

CITATION = ["package_id", "citing_letter_id", "cited_ref_normalized"]


class Resolved(NamedTuple):
    """`scored` has at most three candidates per citation, `exact` the letters of each reference that several letters have."""

    citations: DataFrame
    scored: DataFrame
    exact: DataFrame
    occurrences: DataFrame

    @property
    def candidates(self) -> DataFrame:
        return candidate_rows(self.citations, self.scored, self.exact)


def link_targets(letters: DataFrame) -> DataFrame:
    """Letters a citation may point at: current, not voided, with a reference."""
    return (
        letters.where("is_current AND NOT is_voided")
        .select(
            "package_id", "letter_id", "serial",
            refs.normalize_ref(F.col("letter_ref")).alias("ref"),
        )
        .where("ref <> ''")
    )


def live_mentions(fields: DataFrame, letters: DataFrame) -> DataFrame:
    """Current cited_ref fields with a letter, from readings that still hold a live letter.

    A reading is a run of a document: where letters and fields carry `run_id`, what an earlier run of a document said no
    longer counts. Tables without it read each document once. `field_key` and `is_current` are tested where the fields have them.
    """
    reading = ["package_id", "document_id", *(["run_id"] if "run_id" in fields.columns and "run_id" in letters.columns else [])]
    live = letters.where("is_current AND NOT is_voided").select(*reading)
    if "field_key" in fields.columns:
        fields = fields.where("field_key = 'cited_ref'")
    if "is_current" in fields.columns:
        fields = fields.where("is_current")
    chosen = refs.normalize_ref(refs.choose_ref(F.col("value"), F.col("verbatim")))
    return (
        fields.where(F.col("letter_id").isNotNull())
        .join(grown(live), reading, "left_semi")
        .select(
            "package_id",
            F.col("letter_id").alias("citing_letter_id"),
            "field_index",
            F.coalesce(F.nullif("verbatim", F.lit("")), "value").alias("text"),
            chosen.alias("cited_ref_normalized"),
        )
        .where("cited_ref_normalized <> ''")
    )


def distinct_citations(mentions: DataFrame) -> DataFrame:
    """One row per (citing letter, reference) with the text of its first mention."""
    return mentions.groupBy(*CITATION).agg(F.min_by("text", "field_index").alias("cited_ref_text"))


def _held(targets: DataFrame, key: Column, name: str) -> DataFrame:
    """How many letters share a key, with two of them: enough to drop the citing one."""
    return (
        targets.groupBy("package_id", key.alias(name))
        .agg(
            F.count("*").alias(f"{name}_n"),
            F.min("letter_id").alias(f"{name}_lo"),
            F.max("letter_id").alias(f"{name}_hi"),
        )
        .where(F.col(name) != "")
        .hint("merge")
    )


def _other(name: str) -> tuple[Column, Column]:
    """(matches besides the citing letter, the match when there is exactly one)."""
    itself = F.col(f"{name}_own")
    n = F.coalesce(F.col(f"{name}_n"), F.lit(0)) - itself.cast("int")
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    one = F.when(itself & (lo == F.col("citing_letter_id")), hi).otherwise(lo)
    return n, F.when(n == 1, one)


def apply_direct_rules(
    citations: DataFrame, targets: DataFrame, aliases: DataFrame | None = None
) -> DataFrame:
    """Exact, punctuation-blind and alias rules in one pass; `rule` is null for the remainder."""
    ref = F.col("cited_ref_normalized")
    alnum = refs.letters_and_digits(F.col("ref"))
    own = targets.select("package_id", F.col("letter_id").alias("citing_letter_id"), F.col("ref").alias("own_ref"))
    exact = _held(targets, F.col("ref"), "exact").withColumnRenamed("exact", "cited_ref_normalized")
    # of the citing letter's own reference only whether it is the cited one moves on
    bare, own_bare = refs.letters_and_digits(ref), refs.letters_and_digits(F.col("own_ref"))
    joined = (
        citations.join(grown(own), ["package_id", "citing_letter_id"], "left")
        .withColumn("exact_own", F.coalesce(F.col("own_ref") == ref, F.lit(False)))
        .withColumn("bare_own", F.coalesce(own_bare == bare, F.lit(False)))
        .drop("own_ref")
        .join(exact, ["package_id", "cited_ref_normalized"], "left")
        .withColumn("bare", bare)
        .join(_held(targets, alnum, "bare"), ["package_id", "bare"], "left")
    )
    if aliases is None:
        joined = joined.withColumn("alias_id", F.lit(None).cast(dict(targets.dtypes)["letter_id"]))
    else:
        confirmed = (
            aliases.join(grown(targets).select("package_id", "letter_id"), ["package_id", "letter_id"], "left_semi")
            .select("package_id", F.col("letter_id").alias("alias_id"), "cited_ref_normalized")
        )
        joined = joined.join(grown(confirmed), ["package_id", "cited_ref_normalized"], "left")
    exact_n, exact_id = _other("exact")
    bare_n, bare_id = _other("bare")
    alias_id = F.when(F.col("alias_id") != F.col("citing_letter_id"), F.col("alias_id"))
    rule = (
        F.when(exact_n == 1, "exact")
        .when(exact_n > 1, "exact_many")
        .when(bare_n == 1, "punctuation")
        .when(alias_id.isNotNull(), "alias")
    )
    found = F.when(exact_n > 0, exact_id).when(bare_n == 1, bare_id).otherwise(alias_id)
    return joined.select(*CITATION, "cited_ref_text", rule.alias("rule"), found.alias("direct_id"))


def _ranked_grams(names: DataFrame, gram_use: DataFrame) -> DataFrame:
    """Each reference's grams, rarest in its package first (one bounded list per reference)."""
    return (
        names.select("package_id", "ref", "serial", "tail", F.explode("grams").alias("gram"))
        .join(gram_use, ["package_id", "gram"], "left")
        .groupBy("package_id", "ref")
        .agg(
            F.min("serial").alias("serial"),
            F.first("tail").alias("tail"),
            F.sort_array(
                F.collect_list(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram"))
            ).alias("ranked"),
        )
        .withColumn("grams", F.col("ranked.gram"))
    )


def _rank_both(cited: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of both sides with their grams, worked out once."""

    def gramed(names: DataFrame) -> DataFrame:
        ref = F.col("ref")
        return grown(cut_lineage(names.withColumns({"grams": refs.trigrams(ref), "tail": refs.trailing_serial(ref)})))

    cited, held = gramed(cited), gramed(held)
    gram_use = (
        held.select("package_id", F.explode("grams").alias("gram"))
        .groupBy("package_id", "gram")
        .agg(F.count("*").alias("uses"))
    )
    return grown(cut_lineage(_ranked_grams(cited, gram_use))), grown(cut_lineage(_ranked_grams(held, gram_use)))


def _postings(ranked: DataFrame, side: str, entries: Column) -> DataFrame:
    """One row for each of some leading grams of a reference, with the gram's place and number of parts."""
    kept = [c for c in ranked.columns if c not in ("package_id", "ranked")]
    return ranked.select(
        "package_id", *[F.col(c).alias(f"{side}_{c}") for c in kept], F.posexplode(entries).alias(f"{side}_at", "entry")
    ).select(
        "package_id", *[f"{side}_{c}" for c in kept], f"{side}_at", "entry.gram", "entry.uses",
        # a gram used by many references is joined in parts, or one task would do all its pairs
        F.ceil(F.col("entry.uses") / PART_SIZE).cast("int").alias("parts"),
    )


def _prefix(threshold: Column) -> Column:
    """The rare grams of which a pair at the threshold must share at least one."""
    n = F.size("ranked")
    return F.slice("ranked", F.lit(1), (n - F.ceil(n * threshold) + 1).cast("int"))


def _scored(pairs: DataFrame) -> DataFrame:
    """Similarity of joined postings, each pair at its first shared gram only."""
    # exploding a one-element array keeps the comparison out of the join condition, where it
    # would run before the cheap bounds and once per use
    shared = F.explode(F.array(F.array_intersect("cited_grams", "held_grams")))
    union = F.size("cited_grams") + F.size("held_grams") - F.size("shared")
    return (
        pairs.withColumn("shared", shared)
        .where(F.element_at("shared", 1) == F.col("gram"))
        .withColumn("score", F.size("shared") / union)
    )


def _with_bounds(cited: DataFrame, held: DataFrame, keep: int, threshold: float) -> DataFrame:
    """`least` for each cited reference: the score that `keep` held references are known to reach, or the threshold.

    Known ones are those that share one of the reference's rarest grams, of grams that few references use.
    """
    # the first used grams are the rarest, and unused ones come before them
    used = F.slice(F.filter("ranked", lambda e: e.uses > 0), F.lit(1), F.lit(PROBE_GRAMS))
    few = F.filter(used, lambda e: e.uses <= PROBE_USES)
    a = _postings(cited, "cited", few).select("package_id", "cited_ref", "cited_grams", "gram")
    b = _postings(held, "held", F.filter("ranked", lambda e: e.uses <= PROBE_USES)).select("package_id", "held_grams", "gram")
    best = F.slice(F.sort_array(F.collect_list("score"), asc=False), F.lit(1), F.lit(keep))
    known = (
        _scored(a.join(b, ["package_id", "gram"]))
        .where(F.col("score") >= threshold)
        .groupBy("package_id", F.col("cited_ref").alias("ref"))
        .agg(best.alias("best"))
        .select("package_id", "ref", F.get("best", F.lit(keep - 1)).alias("reached"))
    )
    # hits are ranked by rounded scores, so equal ones have to stay
    least = F.greatest(F.coalesce(F.floor(F.col("reached") * 1e6) / 1e6 - 1e-6, F.lit(0.0)), F.lit(threshold))
    return grown(cited).join(known, ["package_id", "ref"], "left").withColumn("least", least).drop("reached")


def _similar(cited: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Pairs from `least` of the cited reference on, which is at least the threshold."""
    least, common = F.col("cited_least"), F.lit(threshold)
    # equal references of many packages share their rare grams with nothing else: unused grams are not joined
    a = _postings(cited, "cited", _prefix(F.col("least"))).where("parts > 0").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    b = _postings(held, "held", _prefix(common)).withColumn(
        "part", F.pmod(F.xxhash64("held_ref"), F.col("parts")).cast("int")
    )
    n, m = F.size("cited_grams"), F.size("held_grams")
    needed = F.ceil((n + m) * least / (1 + least))
    reachable = F.least(n - F.col("cited_at"), m - F.col("held_at"))
    met = a.drop("parts", "uses").join(b.drop("parts", "uses"), ["package_id", "gram", "part"]).where(
        (m >= n * least) & (n >= m * least) & (reachable >= needed)
    )
    return _scored(met).where(F.col("score") >= least).select(
        "package_id", "cited_ref", "held_ref", "held_serial", "score",
        F.coalesce(F.col("cited_tail") == F.col("held_tail"), F.lit(False)).alias("same_serial"),
    )


def similar_refs(cited: DataFrame, held: DataFrame, threshold: float = MIN_SIMILARITY) -> DataFrame:
    """Exact set-similarity join of `cited` (package_id, ref) with `held` (package_id, ref, serial).

    A pair at or above the threshold shares a gram of both rarest-first prefixes, so common
    grams never act as join keys. Length and position bounds drop most joined rows before the
    gram sets are compared, and a pair is emitted only at its first shared gram, which makes a
    distinct unnecessary.
    """
    threshold -= 1e-9  # a score equal to the threshold must survive rounding
    cited, held = _rank_both(cited.withColumn("serial", F.lit(None).cast("long")), held)
    return _similar(cited.withColumn("least", F.lit(threshold)), held, threshold)


def _nearest(pairs: DataFrame, letters_of_ref: DataFrame, keep: int) -> DataFrame:
    """Best letters per cited reference under the tie rule: score, same serial, letter serial.

    References are ranked by their first letter before their letters are joined: a reference
    behind `keep` others has no letter among the best.
    """

    def best(rows: DataFrame, serial: str) -> DataFrame:
        by_rank = Window.partitionBy("package_id", "cited_ref").orderBy(
            F.round("score", 6).desc(), F.col("same_serial").desc(), serial
        )
        return rows.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= keep).drop("place")

    letters = grown(letters_of_ref).withColumnRenamed("ref", "held_ref")
    return best(best(pairs, "held_serial").drop("held_serial").join(letters, ["package_id", "held_ref"]), "serial")


def _nearest_by_grams(cited: DataFrame, targets: DataFrame) -> DataFrame:
    """The best BEST + 1 letters for each (package_id, ref): one spare for the citing letter.

    Only the first BEST + 1 letters of equal references can ever be placed, so further copies are not joined. The number of
    references above the least similarity grows with the package. So each reference first gets a bound of its own from a few
    references that share its rarest grams: what scores less than the last of its best known ones cannot be placed. The
    similarity join then runs once, with that bound as each reference's threshold; higher ones have shorter prefixes.
    """
    keep = BEST + 1
    copies = Window.partitionBy("package_id", "ref").orderBy("serial")
    letters_of_ref = (
        targets.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= keep)
    )
    held = letters_of_ref.where("copy = 1").select("package_id", "ref", "serial")
    threshold = MIN_SIMILARITY - 1e-9  # a score equal to the threshold must survive rounding
    cited, held = _rank_both(cited.withColumn("serial", F.lit(None).cast("long")), held)
    bounded = _with_bounds(cited, held, keep, threshold)
    return _nearest(_similar(bounded, held, threshold), letters_of_ref.drop("copy"), keep)


def _great_packages(cited: DataFrame, targets: DataFrame) -> tuple[list, int]:
    """Packages with more than WHOLE rows on both sides, one for each so many rows at most, and a number of tasks for the others."""
    rows = cited.select("package_id").unionByName(targets.select("package_id")).where("package_id IS NOT NULL")
    counted = cut_lineage(rows.groupBy("package_id").agg(F.count("*").alias("n")))
    great = [r.package_id for r in counted.where(F.col("n") > WHOLE).collect()]
    small = counted.where(F.col("n") <= WHOLE).agg(F.sum("n")).first()[0] or 0
    return great, max(int(cited.sparkSession.conf.get("spark.sql.shuffle.partitions")), small // TASK_ROWS)


def _placed_whole(cited: DataFrame, targets: DataFrame, tasks: int, keep: int) -> DataFrame:
    """The best letters of each row of `cited` (package_id, citing_letter_id, ref): the best `keep` of its reference without the
    citing letter, and of these the first BEST of a citation if `citing_letter_id` is given.

    References move once, without their grams, to the task of their package; there all of them are compared, in lots of CELLS
    scores. Gives rows (package_id, citing_letter_id, cited_ref, letter_id, held_ref, serial, score, same_serial, place).
    """
    citing = "citing_letter_id" in cited.columns
    held = targets.select("package_id", F.lit(False).alias("cites"), "letter_id", F.col("serial").cast("long").alias("serial"), "ref")
    asking = cited.select(
        "package_id", F.lit(True).alias("cites"),
        (F.col("citing_letter_id") if citing else F.lit(None)).cast(dict(targets.dtypes)["letter_id"]).alias("letter_id"),
        F.lit(None).cast("long").alias("serial"), "ref",
    )
    ref = F.col("ref")
    rows = (
        held.unionByName(asking)
        .where("package_id IS NOT NULL AND ref IS NOT NULL")
        .repartition(tasks, "package_id")
        .withColumns({"grams": refs.trigrams(ref), "tail": refs.trailing_serial(ref)})
    )
    package, letter = rows.schema["package_id"].dataType.simpleString(), rows.schema["letter_id"].dataType.simpleString()
    schema = (
        f"package_id {package}, citing_letter_id {letter}, cited_ref string, letter_id {letter}, held_ref string, "
        "serial long, score double, same_serial boolean, place int"
    )
    least, best, cells = MIN_SIMILARITY - 1e-9, BEST, CELLS

    # local like that of `refs.body_ratio`: workers receive it by value
    def placed(found):
        from decimal import ROUND_HALF_UP, Decimal

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def codes(name):
            return pc.fill_null(found[name].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)

        def ranges(begins, counts):
            """Numbers from each begin on, as many as its count says, one range behind the other."""
            return np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)

        ref, tail, letter = codes("ref"), codes("tail"), codes("letter_id")
        serial = pc.fill_null(found["serial"].combine_chunks(), -(1 << 63)).to_numpy(zero_copy_only=False)
        cites = found["cites"].combine_chunks().to_numpy(zero_copy_only=False)
        grams = found["grams"].combine_chunks()
        size = pc.list_value_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, first = grams.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size

        # of equal references only the first `keep` letters can be placed
        held = np.flatnonzero(~cites)
        held = held[np.lexsort((serial[held], ref[held]))]
        new = np.flatnonzero(np.diff(ref[held], prepend=-1))
        copy = np.arange(len(held)) - np.repeat(new, np.diff(new, append=len(held)))
        held = held[copy < keep]
        asking = np.flatnonzero(cites)
        _, some, named = np.unique(ref[asking], return_index=True, return_inverse=True)
        wanted = asking[some]

        # for each gram the held rows that have it, one behind the other
        vocabulary, gram = np.unique(flat[ranges(first[held], size[held])], return_inverse=True)
        users = np.repeat(np.arange(len(held)), size[held])[np.argsort(gram, kind="stable")]
        uses = np.bincount(gram, minlength=len(vocabulary))
        begins = np.cumsum(uses) - uses
        sought, owner = flat[ranges(first[wanted], size[wanted])], np.repeat(np.arange(len(wanted)), size[wanted])
        at = np.searchsorted(vocabulary, sought)
        used = np.flatnonzero(np.append(vocabulary, 0)[at] == sought) if len(vocabulary) else np.array([], dtype=np.int64)
        used = used[at[used] < len(vocabulary)]
        at, owner = at[used], owner[used]

        parts = []
        step = max(1, cells // max(1, len(held)))
        for begin in range(0, len(wanted), step):
            end = min(begin + step, len(wanted))
            lo, hi = np.searchsorted(owner, [begin, end])
            counts = uses[at[lo:hi]]
            key = np.repeat((owner[lo:hi] - begin) * len(held), counts) + users[ranges(begins[at[lo:hi]], counts)]
            shared = np.bincount(key, minlength=(end - begin) * len(held)).reshape(end - begin, len(held))
            union = size[wanted[begin:end], None] + size[None, held] - shared
            score = shared / np.maximum(union, 1)
            bound = np.full(end - begin, least)
            if len(held) > keep:
                # equal after rounding counts as equal
                bound = np.maximum(bound, np.partition(score, len(held) - keep, axis=1)[:, len(held) - keep] - 2e-6)
            row, col = np.nonzero(score >= bound[:, None])
            value = score[row, col]
            distinct, inverse = np.unique(value, return_inverse=True)
            rounded = [float(Decimal(repr(x)).quantize(Decimal("1e-6"), ROUND_HALF_UP)) for x in distinct.tolist()]
            mine, other = wanted[begin + row], held[col]
            same = (tail[mine] == tail[other]) & (tail[mine] >= 0)
            order = np.lexsort((serial[other], ~same, -np.array(rounded, dtype=np.float64)[inverse], row))
            new = np.flatnonzero(np.diff(row[order], prepend=-1))
            place = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
            order = order[place < keep]
            parts.append((begin + row[order], other[order], value[order], same[order]))
        row, other, value, same = (np.concatenate(x) for x in zip(*parts)) if parts else (np.array([], dtype=np.int64),) * 4

        if citing:
            # each citation has the letters of its reference but itself; rows that repeat are ranked like others
            counts = np.bincount(row, minlength=len(wanted))
            mine = np.repeat(asking, counts[named])
            near = ranges((np.cumsum(counts) - counts)[named], counts[named])
            ok = (letter[mine] != letter[other[near]]) & (letter[mine] >= 0) & (letter[other[near]] >= 0)
            mine, near = mine[ok], near[ok]
            order = np.lexsort((near, ref[mine], letter[mine]))
            mine, near = mine[order], near[order]
            new = np.flatnonzero(np.diff(ref[mine], prepend=-1) | np.diff(letter[mine], prepend=-1))
        else:
            mine, near = wanted[row], np.arange(len(row))
            new = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(mine)) - np.repeat(new, np.diff(new, append=len(mine))) + 1
        if citing:
            stay = place <= best
            mine, near, place = mine[stay], near[stay], place[stay]
        mine, other = pa.array(mine.astype(np.int64)), pa.array(other[near].astype(np.int64))
        columns = [found["package_id"].take(mine), found["letter_id"].take(mine), found["ref"].take(mine)]
        columns += [found["letter_id"].take(other), found["ref"].take(other), found["serial"].take(other)]
        columns += [pa.array(value[near].astype(np.float64)), pa.array(same[near].astype(bool)), pa.array(place.astype(np.int32))]
        names = ["package_id", "citing_letter_id", "cited_ref", "letter_id", "held_ref", "serial", "score", "same_serial", "place"]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    return rows.groupBy("package_id").applyInArrow(placed, schema)


def nearest_letters(cited: DataFrame, targets: DataFrame) -> DataFrame:
    """The best BEST + 1 letters for each (package_id, ref): one spare for the citing letter.

    Packages of a bounded size are compared whole, one in a task; the references of greater ones are joined by their grams.
    """
    great, tasks = _great_packages(cited, targets)
    is_great = F.col("package_id").isin(great)
    whole = _placed_whole(cited.where(~is_great), targets.where(~is_great), tasks, BEST + 1).select(
        "package_id", "held_ref", "cited_ref", "score", "same_serial", "letter_id", "serial"
    )
    if not great:
        return whole
    return whole.unionByName(_nearest_by_grams(cited.where(is_great), targets.where(is_great)).select(whole.columns))


def fuzzy_candidates(remainder: DataFrame, targets: DataFrame) -> DataFrame:
    """At most three scored candidates per citation of the remainder, never the citing letter."""
    asked = remainder.select("package_id", "citing_letter_id", F.col("cited_ref_normalized").alias("ref"))
    great, tasks = _great_packages(asked, targets)
    is_great = F.col("package_id").isin(great)
    placed = _placed_whole(asked.where(~is_great), targets.where(~is_great), tasks, BEST + 1)
    if great:
        asked = asked.where(is_great).withColumnRenamed("ref", "cited_ref")
        near = _nearest_by_grams(asked.select("package_id", F.col("cited_ref").alias("ref")).distinct(), targets.where(is_great))
        by_rank = Window.partitionBy("package_id", "citing_letter_id", "cited_ref").orderBy(
            F.round("score", 6).desc(), F.col("same_serial").desc(), "serial"
        )
        ranked = (
            asked.join(grown(near), ["package_id", "cited_ref"])
            .where(F.col("letter_id") != F.col("citing_letter_id"))
            .withColumn("place", F.row_number().over(by_rank))
            .where(F.col("place") <= BEST)
        )
        placed = placed.unionByName(ranked.select(placed.columns))
    return placed.select(
        "package_id",
        "citing_letter_id",
        F.col("cited_ref").alias("cited_ref_normalized"),
        F.col("letter_id").alias("candidate_letter_id"),
        F.col("held_ref").alias("candidate_ref"),
        F.col("score").alias("match_score"),
        "same_serial",
        "place",
    )


def anchored(candidates: DataFrame) -> DataFrame:
    """Candidates with the cited trailing serial and a similar enough body."""
    return (
        candidates.where("same_serial")
        .withColumn("cited_body", refs.ref_body(F.col("cited_ref_normalized")))
        .withColumn("held_body", refs.ref_body(F.col("candidate_ref")))
        .where("cited_body <> '' AND held_body <> ''")
        .withColumn("body_ratio", refs.body_ratio(F.col("cited_body"), F.col("held_body")))
        .where(F.col("body_ratio") >= MIN_BODY_RATIO)
        .select(*CITATION, "candidate_letter_id", "body_ratio")
    )


def resolve(
    mentions: DataFrame,
    letters: DataFrame,
    aliases: DataFrame | None = None,
) -> Resolved:
    """All rules over all packages given: the batch form of re-resolution, order-independent."""
    targets = grown(cut_lineage(link_targets(letters)))
    direct = grown(cut_lineage(apply_direct_rules(distinct_citations(mentions), targets, aliases)))
    remainder = direct.where("rule IS NULL")
    fuzzy = grown(cut_lineage(fuzzy_candidates(remainder, targets)))
    by_serial = (
        anchored(fuzzy)
        .groupBy(*CITATION)
        .agg(F.count("*").alias("anchored_n"), F.min("candidate_letter_id").alias("anchored_id"))
        .where("anchored_n = 1")
        .drop("anchored_n")
    )
    has_candidates = fuzzy.where("place = 1").select(*CITATION, F.lit(True).alias("has_candidates"))
    resolved_id = F.coalesce("direct_id", "anchored_id")
    citations = (
        direct.join(has_candidates, CITATION, "left")
        .join(by_serial, CITATION, "left")
        .select(
            *CITATION,
            "cited_ref_text",
            resolved_id.alias("cited_letter_id"),
            F.when(resolved_id.isNotNull(), "resolved")
            .when((F.col("rule") == "exact_many") | F.col("has_candidates"), "unresolved_ambiguous")
            .otherwise("unresolved_missing")
            .alias("resolution"),
            F.when(F.col("rule") == "alias", "alias").otherwise("pipeline").alias("resolution_source"),
            F.coalesce(
                "rule", F.when(F.col("anchored_id").isNotNull(), "serial_anchored")
            ).alias("rule"),
        )
    )
    scored = fuzzy.select(
        *CITATION, "candidate_letter_id", F.lit("trgm_fuzzy").alias("match_method"), "match_score"
    )
    return Resolved(citations, scored, shared_references(direct, targets), occurrences(mentions))


def shared_references(direct: DataFrame, targets: DataFrame) -> DataFrame:
    """The letters of every ambiguous reference, once per reference however many letters cite it."""
    shared = direct.where("rule = 'exact_many'").select("package_id", "cited_ref_normalized").distinct()
    held = grown(targets).withColumnRenamed("ref", "cited_ref_normalized")
    return shared.join(held, ["package_id", "cited_ref_normalized"]).select(
        "package_id", "cited_ref_normalized", F.col("letter_id").alias("candidate_letter_id")
    )


def candidate_rows(citations: DataFrame, scored: DataFrame, exact: DataFrame) -> DataFrame:
    """The candidates of each citation: every exact match of an ambiguous reference, and the scored ones.

    A view for reading: of a reference that many letters cite and many have, ask for single packages or citations.
    """
    exact_rows = (
        citations.where("rule = 'exact_many'")
        .select(*CITATION)
        .join(grown(exact), ["package_id", "cited_ref_normalized"])
        .where(F.col("candidate_letter_id") != F.col("citing_letter_id"))
        .select(
            *CITATION,
            "candidate_letter_id",
            F.lit("exact_ref").alias("match_method"),
            F.lit(None).cast("double").alias("match_score"),
        )
    )
    return exact_rows.unionByName(scored)


def asked_candidates(asked: DataFrame, citations: DataFrame, scored: DataFrame, exact: DataFrame) -> DataFrame:
    """The candidates among `asked` (citation key, candidate_letter_id): looked up, nothing is expanded."""
    keys = asked.select(*CITATION, "candidate_letter_id").distinct()
    own = F.col("candidate_letter_id") != F.col("citing_letter_id")
    shared = (
        grown(keys).join(citations.where("rule = 'exact_many'").select(*CITATION), CITATION, "left_semi")
        .join(grown(exact), ["package_id", "cited_ref_normalized", "candidate_letter_id"], "left_semi")
        .where(own)
        .select(*CITATION, "candidate_letter_id", F.lit("exact_ref").alias("match_method"), F.lit(None).cast("double").alias("match_score"))
    )
    return shared.unionByName(scored.join(grown(keys), [*CITATION, "candidate_letter_id"], "left_semi"))


def occurrences(mentions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Every place a reference is mentioned; none are added to human-decided citations."""
    places = mentions.select(*CITATION, "field_index").dropDuplicates()
    if stored is None:
        return places
    human = stored.where("resolution_source = 'human'").select(*CITATION)
    return places.join(grown(human), CITATION, "left_anti")


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh decisions over stored ones; a person's decision and the first printed text stay."""
    both = stored.alias("old").join(grown(fresh).alias("new"), CITATION, "full_outer")
    keep = (F.col("old.resolution_source") == "human") | F.col("new.resolution").isNull()

    def pick(name: str) -> Column:
        return F.when(keep, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name)

    return both.select(
        *CITATION,
        F.coalesce("old.cited_ref_text", "new.cited_ref_text").alias("cited_ref_text"),
        pick("cited_letter_id"),
        pick("resolution"),
        pick("resolution_source"),
    )


def confirm(
    citations: DataFrame, candidates: DataFrame, confirmations: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Human confirmations -> (citations, aliases learned, rejected confirmations).

    Of `candidates` those among the confirmations suffice (`asked_candidates`).
    Confirmations carry the citation key, `candidate_letter_id` and an increasing `confirmed_at`. A citation takes its first
    valid one. A reference without exact match is known by the alias from its first decision on: other letters' citations of
    it are resolved by then and their decisions refused, except where the alias is the citing letter itself. An alias keeps
    the latest accepted decision per reference.
    """
    ambiguous = citations.where("resolution = 'unresolved_ambiguous'").select(
        *CITATION, F.lit(True).alias("open")
    )
    recorded = candidates.groupBy(*CITATION, "candidate_letter_id").agg(
        F.lit(True).alias("recorded"), F.max(F.col("match_method") == "trgm_fuzzy").alias("scored")
    )
    checked = confirmations.join(grown(ambiguous), CITATION, "left").join(
        grown(recorded), [*CITATION, "candidate_letter_id"], "left"
    )
    own = checked.where("open AND recorded").groupBy(*CITATION).agg(
        F.min_by("candidate_letter_id", F.struct("confirmed_at", "candidate_letter_id")).alias("chosen"),
        F.min("confirmed_at").alias("chosen_at"),
        F.max("scored").alias("scored"),
    )
    reference = ["package_id", "cited_ref_normalized"]
    known = own.where("scored").groupBy(*reference).agg(
        F.min_by("chosen", F.struct("chosen_at", "citing_letter_id")).alias("alias_id"),
        F.min(F.struct("chosen_at", "citing_letter_id")).alias("alias_at"),
    )
    resolved_before = F.coalesce(
        F.col("scored")
        & (F.struct("chosen_at", "citing_letter_id") > F.col("alias_at"))
        & (F.col("alias_id") != F.col("citing_letter_id")),
        F.lit(False),
    )
    decided = grown(cut_lineage(own.join(grown(known), reference, "left").withColumn("late", resolved_before)))
    first = decided.where("NOT late").select(*CITATION, "chosen", "chosen_at")
    judged = checked.join(decided.select(*CITATION, "chosen", "chosen_at", "late"), CITATION, "left")
    accepted = (
        (F.col("candidate_letter_id") == F.col("chosen")) & (F.col("confirmed_at") == F.col("chosen_at")) & ~F.col("late")
    )
    rejected = judged.where(~F.coalesce(accepted, F.lit(False))).select(
        *CITATION,
        "candidate_letter_id",
        "confirmed_at",
        F.when(F.col("open").isNull(), "not_ambiguous")
        .when(F.col("recorded").isNull(), "not_a_candidate")
        .when(F.col("late"), "already_resolved_by_alias")
        .otherwise("already_confirmed")
        .alias("reason"),
    )
    linked = citations.join(grown(first), CITATION, "left").withColumns(
        {
            "cited_letter_id": F.coalesce("chosen", "cited_letter_id"),
            "resolution": F.when(F.col("chosen").isNotNull(), "resolved").otherwise(F.col("resolution")),
            "resolution_source": F.when(F.col("chosen").isNotNull(), "human").otherwise(
                F.col("resolution_source")
            ),
        }
    ).drop("chosen", "chosen_at")
    aliases = first.groupBy("package_id", "cited_ref_normalized").agg(
        F.max_by("chosen", F.struct("chosen_at", "citing_letter_id")).alias("letter_id")
    )
    return linked, aliases, rejected


class Confirmed(NamedTuple):
    citations: DataFrame
    candidates: DataFrame
    aliases: DataFrame
    rejected: DataFrame


def apply_confirmations(
    stored: DataFrame,
    candidates: DataFrame,
    confirmations: DataFrame,
    mentions: DataFrame,
    letters: DataFrame,
    known: DataFrame | None = None,
) -> Confirmed:
    """Confirmations carried through: links decided, aliases learned, packages with a new alias resolved again with all of theirs.

    `known` are aliases learned before; a new decision on a reference replaces the old alias. Links that a person decided stay
    as they are, and so do packages without a new alias; threads follow from the result (`threads.updated_components`).
    """
    linked, learned, rejected = confirm(stored, candidates, confirmations)
    learned = grown(cut_lineage(learned))
    touched = grown(learned.select("package_id").distinct())
    aliases = learned
    if known is not None:
        older = known.select("package_id", "cited_ref_normalized", "letter_id").join(
            learned, ["package_id", "cited_ref_normalized"], "left_anti"
        )
        aliases = cut_lineage(learned.unionByName(older))

    def of_touched(rows: DataFrame) -> DataFrame:
        return rows.join(touched, "package_id", "left_semi")

    again = resolve(of_touched(mentions), of_touched(letters), aliases)
    offered = again.candidates.unionByName(candidates.join(touched, "package_id", "left_anti"))
    return Confirmed(upsert(linked, again.citations), offered, aliases, rejected)


def backfill_source(citations: DataFrame) -> DataFrame:
    """Resolved links whose source was never recorded count as human decisions."""
    unknown = F.col("resolution_source").isNull()
    return citations.withColumn(
        "resolution_source",
        F.when(unknown & (F.col("resolution") == "resolved"), "human")
        .when(unknown, "pipeline")
        .otherwise(F.col("resolution_source")),
    )
