"""Reference strings: normalisation, choice of printed form, serials and similarity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The characters Unicode-aware whitespace tests accept.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NON_ASCII = r"[^\x00-\x7F]"
TRAILING_SERIAL = r"(\p{Nd}{2,})(?!.*\p{Nd})"
NUMBER_LABEL = rf"^NO(?:\.|{SPACE})+"


def nfc(text: Column) -> Column:
    """Unicode NFC on the JVM (ICU ships with Spark); plain ASCII rows never reach it."""
    composed = F.call_function(
        "java_method",
        F.lit("com.ibm.icu.text.Normalizer"),
        F.lit("compose"),
        text.cast("string"),
        F.lit(False),
    )
    return F.when(text.rlike(NON_ASCII), composed).otherwise(text)


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    """Whitespace runs become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def normalize_ref(ref: Column) -> Column:
    return F.upper(collapse_space(nfc(ref)))


def letters_and_digits(ref: Column) -> Column:
    """Upper-cased letters and digits only, without a leading 'No.' label."""
    return F.regexp_replace(F.regexp_replace(F.upper(ref), NUMBER_LABEL, ""), r"[^\p{L}\p{N}]", "")


def squash(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, rf"{SPACE}+", ""))


def _present(text: Column) -> Column:
    """Stripped text; blank and the literal word null count as absent."""
    bare = strip_space(text)
    return F.when((bare != "") & (F.lower(bare) != "null"), bare)


def choose_ref(value: Column, verbatim: Column) -> Column:
    """The tight value when the located text contains it, the located text otherwise."""
    value, verbatim = _present(value), _present(verbatim)
    inside = F.contains(squash(verbatim), squash(value))
    return F.coalesce(F.when(verbatim.isNull() | inside, value), verbatim)


def trailing_serial(ref: Column) -> Column:
    """The last digit run when it has at least two digits, else null."""
    found = F.regexp_extract(ref, TRAILING_SERIAL, 1)
    return F.when(found != "", found)


def ref_body(ref: Column) -> Column:
    return letters_and_digits(F.regexp_replace(ref, TRAILING_SERIAL, ""))


def body_ratio(cited: Column, candidate: Column) -> Column:
    """Matching-blocks ratio of two bodies; only a citation's last three candidates get here.

    The function is local so that workers receive it by value and need no copy of this package.
    """

    @F.pandas_udf(DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = zip(left, right)
        return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs], dtype="float64")

    return ratio(cited, candidate)


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the padded lower-case words, each packed into one long.

    A code point takes 21 bits, so three of them fit and no two grams share a number.
    Numbers keep the set operations on Spark's primitive hash sets.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    points = F.transform(
        padded, lambda w: F.transform(F.split(w, ""), lambda c: F.ascii(c).cast("long"))
    )
    packed = F.transform(
        points,
        lambda p: F.transform(
            F.sequence(F.lit(1), F.size(p) - 2),
            lambda i: F.shiftleft(F.element_at(p, i), 42)
            + F.shiftleft(F.element_at(p, i + 1), 21)
            + F.element_at(p, i + 2),
        ),
    )
    return F.array_distinct(F.flatten(packed))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all grams of two gram sets, 0 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))
