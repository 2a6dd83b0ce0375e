"""Reference strings: forms, choice, serials, similarity."""

import difflib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from missive.functions import fields as fv
from missive.functions import refs


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ("No. PW/CE/NH/22/2018/Pt/47", "PW-CE-NH-22-2018-PT-47", True),
        ("NOIDA/12", "IDA/12", False),
        ("AE/PKG3/2024/091", "AE / PKG3 / 2024 / 091", True),
        ("AE/PKG3/2024/091", "AE/PKG3/2024/092", False),
    ],
)
def test_punctuation_blind_form(spark, a, b, equal):
    same = refs.letters_and_digits(F.col("a")) == refs.letters_and_digits(F.col("b"))
    assert one(spark, same, a=a, b=b) is equal


def test_normalized_form_keeps_punctuation(spark):
    assert one(spark, refs.normalize_ref(F.col("a")), a="  ae / pkg3 \n2024 ") == "AE / PKG3 2024"
    assert one(spark, refs.normalize_ref(F.col("a")), a="é/1") == "É/1"


@pytest.mark.parametrize(
    "value, verbatim, chosen",
    [
        ("L.14/5(16)2025/61", "L.14/5(16)2025/61 Dated Shillong, the 24 May, 2026", "L.14/5(16)2025/61"),
        ("null", "null", None),
        ("null", "AE/1", "AE/1"),
        ("AE/1", "", "AE/1"),
        ("AE/9", "AE/1", "AE/1"),
        ("AE/ 1", "letter AE / 1", "AE/ 1"),
        (None, None, None),
    ],
)
def test_choice_of_reference(spark, value, verbatim, chosen):
    assert one(spark, refs.choose_ref(F.col("v"), F.col("t")), v=value, t=verbatim) == chosen


@pytest.mark.parametrize(
    "ref, serial, body",
    [
        ("GEN(I)/NH/8/2021/344", "344", "GENINH82021"),
        ("GEN(D/NH/8/2021/344 OO", "344", "GENDNH82021OO"),
        ("A/12/3", None, "A123"),
        ("NO DIGITS", None, "DIGITS"),
        ("A/7", None, "A7"),
    ],
)
def test_serial_and_body(spark, ref, serial, body):
    assert one(spark, refs.trailing_serial(F.col("r")), r=ref) == serial
    assert one(spark, refs.ref_body(F.col("r")), r=ref) == body


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("word", "two words", 4 / 11),
        ("GEN(I)/NH/8/2021/344", "GEN(D/NH/8/2021/344 Oo", 0.72),
        ("NHAI/PKG3/2O24/117", "NHAI/PKG3/2024/117", 0.727),
    ],
)
def test_trigram_similarity(spark, a, b, score):
    got = one(spark, refs.trigram_similarity(F.col("a"), F.col("b")), a=a, b=b)
    assert got == pytest.approx(score, abs=0.001)


def grams(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def test_trigrams_match_set_arithmetic(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB12/-. éह") for _ in range(rng.randint(0, 14))) for _ in range(120)]
    pairs = [(a, b) for a, b in zip(texts, reversed(texts))]
    rows = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", refs.trigram_similarity(F.col("a"), F.col("b")).alias("s")
    )
    for a, b, s in rows.collect():
        union = grams(a) | grams(b)
        assert s == pytest.approx(len(grams(a) & grams(b)) / len(union) if union else 0), (a, b)


@pytest.mark.parametrize(
    "a, b, ratio",
    [("GENINH82021", "GENDNH82021OO", 0.833), ("AEPKG32023", "CTRPKG42024", 0.571), ("NHAIPKG32O24", "NHAIPKG32024", 0.917)],
)
def test_body_ratio(spark, a, b, ratio):
    got = one(spark, refs.body_ratio(F.col("a"), F.col("b")), a=a, b=b)
    assert got == pytest.approx(ratio, abs=0.001)
    assert got == difflib.SequenceMatcher(None, a, b).ratio()


def test_nfc_equals_the_unicode_standard(spark):
    texts = ["e\u0301", "\u0915\u093c", "\u212b", "plain", "a\u0307\u0323", "\U0001f600 e\u0301", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", refs.nfc(F.col("t")).alias("n"))
    assert all(n == unicodedata.normalize("NFC", t) for t, n in rows.collect())


@pytest.mark.parametrize(
    "text, day",
    [("2024-03-12", "2024-03-12"), (" 2024-03-12 ", "2024-03-12"), ("2024-02-30", None), ("null", None), ("N/A", None),
     ("-", None), ("12.03.2024", None), ("", None), (None, None)],
)
def test_dates(spark, text, day):
    got = one(spark, fv.as_date(F.col("t")), t=text)
    assert (got and got.isoformat()) == day


def test_field_values(spark):
    assert one(spark, fv.parse_chainage(F.col("t")), t="at Km 12+400 and Km 13+000") == 12400
    assert one(spark, fv.parse_chainage(F.col("t")), t="km 12+400") is None
    assert one(spark, fv.parse_chainage_range(F.col("t")), t="Km 12+400 – Km 14+250") == (12400, 14250)
    assert one(spark, fv.suggestion_text(F.col("t")), t="box-culvert a.b") == "Box-Culvert A.B"
    assert one(spark, fv.suggestion_text(F.col("t")), t="pkg3 road") == "pkg3 road"
    assert one(spark, fv.search_words(F.col("t")), t="-Potholes... at Km 1+2, a") == ["potholes", "at", "km", "1+2"]
    assert one(spark, fv.format_date(F.col("t").cast("date")), t=None) == "—"
    shown = fv.display_value(F.lit("cited_ref"), F.col("v"), F.col("t"))
    assert one(spark, shown, v="tight", t="printed") == "printed"
