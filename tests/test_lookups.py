"""Many moments, prefixes and registers at once against plain loops and the operators for one."""

import datetime as dt
import random

import pytest

from missive.operators import audit, search, versions

VERSIONS = "package_id long, serial long, letter_id long, created_at timestamp"
ASKED = "package_id long, serial long, moment timestamp, note string"


@pytest.mark.parametrize("seed", [1, 2])
def test_as_of_each_equals_plain_search(spark, seed):
    rng = random.Random(seed)
    start = dt.datetime(2020, 1, 1)

    def when():
        # few hours of few days: many ties
        return start + dt.timedelta(days=rng.randrange(6), hours=rng.randrange(4))

    # one letter holds a third of all versions and asks
    def letter():
        return rng.choice([(1, 1), (rng.randrange(3), rng.randrange(4)), (rng.randrange(3), rng.randrange(4))])

    held = [(*letter(), i, when()) for i in range(80)] + [(1, 1, 900, None)]
    asked = [(*letter(), when(), "x") for _ in range(120)]
    odd = [(1, 1, None, "x"), (None, 1, start, "x"), (1, None, start, "x"), (77, 1, start, "x")]
    got = versions.as_of_each(spark.createDataFrame(held, VERSIONS), spark.createDataFrame(asked + asked[:9] + odd, ASKED))
    assert got.columns == ["package_id", "serial", "moment", "letter_id", "created_at"]
    expected = {}
    for p, s, at, _ in asked + odd:
        live = [(c, i) for q, t, i, c in held if (q, t) == (p, s) and c is not None and at is not None and c <= at]
        expected[p, s, at] = max(live, default=(None, None))
    rows = got.collect()
    assert len(rows) == len(expected)
    assert {(r.package_id, r.serial, r.moment): (r.created_at, r.letter_id) for r in rows} == expected


def test_as_of_each_on_empty_tables(spark):
    held = spark.createDataFrame([(1, 1, 5, dt.datetime(2020, 1, 1))], VERSIONS)
    asked = spark.createDataFrame([(1, 1, dt.datetime(2021, 1, 1), "x")], ASKED)
    assert versions.as_of_each(held, asked.limit(0)).collect() == []
    assert [r.letter_id for r in versions.as_of_each(held.limit(0), asked).collect()] == [None]


def test_completions_equal_single_matches(spark):
    rng = random.Random(5)
    parts = ["Culvert", "cu", "cul", "CULV", "box", "b-12", "12/34", "a_bc", "Ab", "ß", "x"]
    rows = {(rng.randrange(2), "subject", rng.choice([" ", "/", "-"]).join(rng.choices(parts, k=rng.randrange(1, 4)))) for _ in range(150)}
    index = spark.createDataFrame(
        [(*r, rng.randrange(3)) for r in sorted(rows)] + [(0, "ref", None, 1), (0, "ref", "", 1)],
        "package_id long, kind string, text string, count long",
    )
    table = search.completions(index, limit=3).cache()
    asks = ["cu", "CUL", "culv", "bo", "b-", "12", "12/3", " ab", "a_b", "x c", "zz", "bc", "cu "]
    asked = spark.createDataFrame([(p, q) for p in (0, 1) for q in asks], "package_id long, query string")
    got = {}
    for r in search.complete(table, asked).collect():
        got.setdefault(r.query, set()).add((r.package_id, r.kind, r.text, r["count"], r["rank"]))
    for q in asks:
        one = search.match_suggestions(index, q, limit=3).collect()
        assert got.get(q, set()) == {(r.package_id, r.kind, r.text, r["count"], r["rank"]) for r in one}, q
    assert search.completions(index.limit(0)).collect() == []


def test_nested_diff_equals_flat_diff(spark, monkeypatch):
    rng = random.Random(9)
    schema = "package long, letter long, field long, value string, other string, boxes array<double>, extra string"
    rows = {
        (p, t, f): [rng.choice([None, "a", "b"]), rng.choice([None, "a"]), rng.choice([None, [], [1.0, None], [None, 1.0]])]
        for p in range(8) for t in range(5) for f in range(4)
    }
    other = {k: list(v) for k, v in rows.items()}
    other[1, 2, 3][0], other[1, 2, 3][1] = other[1, 2, 3][1], other[1, 2, 3][0]
    other[1, 2, 0][0] = "changed"
    # the same values in other columns, or at another place of a list
    rows[3, 0, 0], other[3, 0, 0] = [None, "a", None], ["a", None, None]
    rows[3, 0, 1], other[3, 0, 1] = ["a", "a", [1.0, None]], ["a", "a", [None, 1.0]]
    # two fields that swap their values
    rows[4, 1, 0], rows[4, 1, 1] = ["p", None, None], ["q", None, None]
    other[4, 1, 0], other[4, 1, 1] = ["q", None, None], ["p", None, None]
    del other[5, 0, 0]
    other[90, 1, 1] = ["new", None, None]

    def frame(side):
        return spark.createDataFrame([(*k, *v, "not compared") for k, v in side.items()], schema)

    left, right = frame(rows), frame(other)
    keys, compared = ["package", "letter", "field"], ["value", "other", "boxes"]

    def told(found):
        return sorted(tuple(map(str, r)) for r in found.collect())

    flat, seen = told(audit.register_diff(left, right, keys, compared)), []
    plain = audit.register_diff

    def watched(a, b, *rest):
        seen.extend((r.package, r.letter) for r in a.unionByName(b).select("package", "letter").distinct().collect())
        return plain(a, b, *rest)

    monkeypatch.setattr(audit, "register_diff", watched)
    levels = [["package"], ["letter"], ["field"]]
    assert told(audit.nested_diff(left, right, levels, compared)) == flat
    # only letters that differ are compared row by row
    assert sorted(seen) == [(1, 2), (3, 0), (4, 1), (5, 0), (90, 1)]
    assert told(audit.nested_diff(left, left, levels, compared)) == []
    assert len(told(audit.nested_diff(left, right.limit(0), levels, compared))) == len(rows)
    assert told(audit.nested_diff(left.limit(0), right.limit(0), levels, compared)) == []
