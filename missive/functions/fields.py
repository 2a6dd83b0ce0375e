"""Values of single fields: dates, parties, chainage, page ranges, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .refs import SPACE, strip_space

# Words an extraction may return instead of a date.
NO_DATE = ["null", "none", "n/a", "-", "unknown"]
DASH = "—"
CHAINAGE = rf"Km{SPACE}*(\d+)\+(\d{{3}})"


def as_date(text: Column) -> Column:
    """A calendar date written YYYY-MM-DD; anything else is null, never an error."""
    bare = strip_space(text)
    usable = bare.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~F.lower(bare).isin(NO_DATE)
    return F.when(usable, bare).try_cast("date")


def party_code(text: Column, codes: Column) -> Column:
    """CTR or AE by wording, only where the package has that party; PD is never inferred."""
    lowered = F.lower(text)
    return F.when(
        lowered.contains("contractor") & F.array_contains(codes, "CTR"), F.lit("CTR")
    ).when(lowered.contains("engineer") & F.array_contains(codes, "AE"), F.lit("AE"))


def direction(from_code: Column, to_code: Column) -> Column:
    """Outward from the contractor, inward to them, null when neither side is known."""
    return F.when(from_code == "CTR", F.lit("outward")).when(to_code == "CTR", F.lit("inward"))


def format_date(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "dd MMM yyyy"), F.lit(DASH))


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def parse_chainage(text: Column) -> Column:
    """Metres of the first 'Km a+bbb'; case matters."""
    km = F.regexp_extract(text, CHAINAGE, 1)
    metres = F.regexp_extract(text, CHAINAGE, 2)
    return F.when(km != "", km.try_cast("long") * 1000 + metres.try_cast("long"))


def parse_chainage_range(text: Column) -> Column:
    """Inclusive {lo, hi} in metres over every point named in the text."""
    kms = F.regexp_extract_all(text, F.lit(CHAINAGE), F.lit(1))
    metres = F.regexp_extract_all(text, F.lit(CHAINAGE), F.lit(2))
    points = F.zip_with(
        kms, metres, lambda k, m: k.try_cast("long") * 1000 + m.try_cast("long")
    )
    return F.when(
        F.size(kms) > 0,
        F.struct(F.array_min(points).alias("lo"), F.array_max(points).alias("hi")),
    )


def ranges_overlap(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    return F.greatest(a_from, b_from) <= F.least(a_to, b_to)


def display_value(field_key: Column, value: Column, verbatim: Column) -> Column:
    """References show what is printed first; other fields show the normalised value first."""
    return F.when(
        field_key.isin("letter_ref", "cited_ref"), F.coalesce(verbatim, value, F.lit(DASH))
    ).otherwise(F.coalesce(value, verbatim, F.lit(DASH)))


def search_words(text: Column) -> Column:
    """Lower-case words of a subject line; dots and hyphens at the ends fall away."""
    parts = F.split(F.lower(text), r"[^a-z0-9+/().-]+")
    trimmed = F.transform(parts, lambda w: F.regexp_replace(w, r"^[-.]+|[-.]+$", ""))
    return F.filter(trimmed, lambda w: F.length(w) > 1)


def suggestion_text(raw: Column) -> Column:
    """Title case, except text with digits, slashes or brackets, which is an identifier."""
    spaced = F.regexp_replace(raw, r"(?<=[+.\-])(?=[a-z])", "\u0001 ")
    return F.when(raw.rlike("[0-9/()]"), raw).otherwise(
        F.replace(F.initcap(spaced), F.lit("\u0001 "), F.lit(""))
    )
