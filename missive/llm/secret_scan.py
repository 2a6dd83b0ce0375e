"""Secrets in texts, with column functions only.

Three patterns find assignments, access keys and hexadecimal runs. Beyond them, long runs of key characters are candidates: a
window slides over a candidate, the counts of its characters are kept up by adding the character that enters and taking off
the one that leaves, and the window's Shannon entropy follows from the counts. Candidates of hexadecimal digits and of other
key characters have thresholds of their own; an allow-list suppresses placeholders and words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns, by kind, with the group whose length counts and its least length. A failing match still uses
# up its text, so the lengths are tested after matching; where that makes no difference the pattern has the length in it.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALLOWED = r"(?i)example|sample|dummy|placeholder|changeme|x{6}|0123456789|abcdef|(.)\1{7}|^[^0-9]*$|^[^A-Za-z]*$"
WINDOW = 20
HEX_BITS = 2.9
KEY_BITS = 3.7
# candidates are ASCII from '+' to 'z'
FIRST_CODE, CODES = 43, 80
MILLIONTHS = 1_000_000

SPAN = "array<struct<kind:string,start:int,end:int>>"
MASK = "[SECRET]"


def _found(text: Column, pattern: str) -> Column:
    """Start and end, in code points, of all matches of a pattern that never matches nothing."""
    regex = F.lit(pattern)
    # the pieces between the matches are split off by the same pattern, so both lists run side by side
    lengths = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, regex, F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    walked = F.aggregate(
        F.filter(lengths, lambda x: x.hit.isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda s, x: F.struct(
            (s.at + x.gap + x.hit).alias("at"),
            F.array_append(s.found, F.struct((s.at + x.gap).alias("start"), (s.at + x.gap + x.hit).alias("end"))).alias("found"),
        ),
    )
    return F.when(text.rlike(pattern), walked["found"]).otherwise(none)


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s.start.alias("start"), s.end.alias("end")))


def _assigned(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    long_enough = F.zip_with(
        _found(text, ASSIGN), values, lambda s, v: F.when(F.length(v) >= ASSIGN_LEAST, s)
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(text.rlike(ASSIGN), F.filter(long_enough, lambda s: s.isNotNull())).otherwise(none)


def _n_log_n() -> Column:
    """n log2 n in millionths, by n: sums of whole numbers leave no rounding behind."""
    return F.array(*[F.lit(round(n * math.log2(n) * MILLIONTHS) if n else 0).cast("long") for n in range(WINDOW + 1)])


def _dense_part(candidate: Column) -> Column:
    """From the first to the last window with enough entropy: struct(first, last) of window starts, -1 where there is none."""
    is_hex = candidate.rlike("^[0-9A-Fa-f]+$")
    least = F.when(is_hex, F.lit(HEX_BITS)).otherwise(F.lit(KEY_BITS))
    # entropy >= least  <=>  sum of n log2 n <= WINDOW * (log2 WINDOW - least)
    most = F.floor(F.lit(WINDOW * MILLIONTHS) * (F.lit(math.log2(WINDOW)) - least)).cast("long")
    codes = F.transform(F.split(candidate, "", -1), lambda c: F.ascii(c) - FIRST_CODE)
    weights = _n_log_n()

    def walked(signs: Column, length: Column, weights: Column, most: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            # -1: nothing leaves yet
            entering, leaving = signs[i], F.when(i >= WINDOW, signs[i - WINDOW]).otherwise(-1)
            grown, shrunk = s.counts[entering], F.when(leaving >= 0, s.counts[leaving]).otherwise(1)
            change = weights[grown + 1] - weights[grown] + weights[shrunk - 1] - weights[shrunk]
            same = entering == leaving
            weight = F.when(same, s.weight).otherwise(s.weight + change)
            counts = F.when(same, s.counts).otherwise(
                F.transform(
                    s.counts,
                    lambda n, c: F.when(c == entering, n + 1).when(c == leaving, n - 1).otherwise(n),
                )
            )
            start = (i - (WINDOW - 1)).cast("int")
            dense = (i >= WINDOW - 1) & (weight <= most)
            return F.struct(
                counts.alias("counts"),
                weight.alias("weight"),
                F.when(dense & (s["first"] < 0), start).otherwise(s["first"]).alias("first"),
                F.when(dense, start).otherwise(s["last"]).alias("last"),
            )

        begin = F.struct(
            F.array_repeat(F.lit(0), CODES).alias("counts"),
            F.lit(0).cast("long").alias("weight"),
            F.lit(-1).alias("first"),
            F.lit(-1).alias("last"),
        )
        return F.aggregate(
            F.sequence(F.lit(0), length - 1),
            begin,
            step,
            lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")),
        )

    # signs and weights stay outside the accumulator, which is copied at every step
    held = F.array(F.struct(codes.alias("signs"), F.length(candidate).alias("length"), weights.alias("weights"), most.alias("most")))
    return F.transform(held, lambda h: walked(h.signs, h.length, h.weights, h.most))[0]


def _entropic(text: Column) -> Column:
    none = F.array().cast("array<struct<start:int,end:int>>")
    judged = F.zip_with(
        _found(text, CANDIDATE),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
        lambda s, c: F.struct(s.start.alias("at"), F.when(~c.rlike(ALLOWED), _dense_part(c)).alias("part")),
    )
    dense = F.filter(judged, lambda j: F.coalesce(j.part["first"] >= 0, F.lit(False)))
    spans = F.transform(
        dense,
        lambda j: F.struct(
            (j["at"] + j.part["first"]).alias("start"), (j["at"] + j.part["last"] + WINDOW).alias("end")
        ),
    )
    return F.when(text.rlike(CANDIDATE), spans).otherwise(none)


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            s.start.alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s.kind).alias("place"), s.end.alias("end"), s.kind.alias("kind")
        ),
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))
    )


def _uncovered(span: Column, base: Column) -> Column:
    """The span has a sign that no base span covers: a walk over the base spans by start never gets behind its end."""
    inside = F.filter(base, lambda b: (b.start < span.end) & (span.start < b.end))
    walk = F.array_sort(F.transform(inside, lambda b: F.struct(b.start.alias("start"), b.end.alias("end"))))
    covered = F.aggregate(walk, span.start, lambda at, b: F.when(b.start <= at, F.greatest(at, b.end)).otherwise(at))
    return covered < span.end


def spans(docs: DataFrame, text_col: str = "text", out: str = "secret_spans") -> DataFrame:
    """The rows of `docs` with one more column: their secrets, array of (kind, start, end), by start and kind.

    Kinds are those of KINDS; positions count code points, the end is exclusive. Spans of one pattern don't overlap, spans
    of different patterns may. An entropy span is left out only where spans of patterns cover all of it. A missing text has no spans; a column named like the new one is replaced, all
    others stay; repeated rows stay repeated.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_named(_assigned(text), "assign"), _named(_found(text, ACCESS), "access"), _named(_found(text, HEX), "hex"))
    more = _named(_entropic(text), "entropy")
    staged = docs.drop(out).withColumn(out, F.struct(base.alias("base"), more.alias("more")))
    apart = F.filter(F.col(out)["more"], lambda m: _uncovered(m, F.col(out)["base"]))
    joined = F.when(
        (F.size(F.col(out)["base"]) > 0) | (F.size(F.col(out)["more"]) > 0), _ordered(F.concat(F.col(out)["base"], apart))
    ).otherwise(F.array().cast(SPAN))
    return staged.withColumn(out, joined)


def listed(found: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every secret replaced by MASK, overlapping spans by one; all other columns stay as they are.

    A missing text stays missing, an empty one empty; repeated rows stay repeated, no rows give no rows.
    """
    text = F.col(text_col)

    def cover(s: Column, x: Column) -> Column:
        begins = x.start >= s.at
        return F.struct(
            F.greatest(s.at, x.end).alias("at"),
            F.when(begins, F.concat(s.out, F.substring(text, s.at + 1, x.start - s.at), F.lit(MASK))).otherwise(s.out).alias("out"),
        )

    own = "secret_spans_of_redaction"
    while own in (c.lower() for c in docs.columns):
        own += "_"
    found = spans(docs, text_col, own)
    walked = F.aggregate(own, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cover)
    rebuilt = F.transform(F.array(walked), lambda w: F.concat(w.out, F.substring(text, w["at"] + 1, F.length(text))))[0]
    return found.withColumn(text_col, F.when(F.size(own) > 0, rebuilt).otherwise(text)).select(docs.columns)
