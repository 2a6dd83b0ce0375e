"""What moves at a shuffle: joins over growing tables sort both sides at any size, and rows carry no more than the next step needs."""

from __future__ import annotations

import pytest

from missive.operators import citations, ranges, reprocessing, versions
from missive.plans import bridge

from test_growing_joins import plan_of, tables


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def kept(spark, tmp_path):
    """Tables read from files, whose size is what Spark goes by."""

    def keep(rows, schema, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return keep


def test_overlaps_broadcast_no_table_and_keep_every_pair(kept):
    spans = [(0, 7), (3, 3), (5, 900), (8, 20), (1, 40_000), (7, 8), (9, 2), (0, 0), (39_999, 80_000)]
    a = kept([(g, i, lo, hi) for g in (0, 1, 2) for i, (lo, hi) in enumerate(spans)], "g int, a int, lo long, hi long", "a")
    b = kept([(g, i, lo, hi) for g in (0, 1) for i, (lo, hi) in enumerate(spans)], "g int, b int, b_lo long, b_hi long", "b")
    pairs = ranges.overlap_pairs(a, b, ["g"], ("lo", "hi"), ("b_lo", "b_hi"))
    assert "Broadcast" not in plan_of(pairs)
    good = [(i, s) for i, s in enumerate(spans) if s[0] <= s[1]]
    expected = sorted((g, i, j) for g in (0, 1) for i, s in good for j, t in good if s[0] <= t[1] and t[0] <= s[1])
    assert sorted((r.g, r.a, r.b) for r in pairs.collect()) == expected


def test_second_reading_broadcasts_no_table(kept):
    held = kept(
        [(0, "D", 1, 1, "A/1", 1, 2, True, None, "unverified")],
        "package_id long, document_id string, letter_id long, serial long, letter_ref_normalized string, page_from int, page_to int,"
        " is_current boolean, superseded_by string, review_status string",
        "held",
    )
    read = kept(
        [(0, "D", 0, "A/1", 1, 1), (0, "D", 1, "A/2", 7, 8)],
        "package_id long, document_id string, candidate int, letter_ref_normalized string, page_from int, page_to int",
        "read",
    )
    packages = kept([(0, 2)], "package_id long, next_serial long", "packages")
    matches = reprocessing.match_reprocessed(held, read)
    after, events = reprocessing.apply_reprocessing(held, matches, packages)
    for df in (matches, after, events):
        assert "Broadcast" not in plan_of(df)
    assert sorted((r.serial, r.is_current) for r in after.collect()) == [(1, False), (1, True), (2, True)]


def test_moments_share_one_shuffle_of_events(kept):
    letters = kept([(0, 1, 10, "1998-01-01"), (0, 1, 11, "1998-01-05")], "package_id long, serial long, letter_id long, at string", "letters")
    letters = letters.selectExpr("package_id", "serial", "letter_id", "CAST(at AS date) AS created_at")
    asked = letters.selectExpr("package_id", "serial", "date_add(created_at, 1) AS moment")
    live = versions.as_of_each(letters, asked)
    assert "Broadcast" not in plan_of(live)
    assert {(str(r.moment), r.letter_id) for r in live.collect()} == {("1998-01-02", 10), ("1998-01-06", 11)}
    # the last version of a day comes from the ordered events, not from an aggregation of them beside it
    assert not any("Aggregate" in x and "max(" in x for x in optimized(live).splitlines())


def test_reviewed_fields_move_once(kept):
    fields = kept(
        [(1, 5, "a", "a", 1, "exact", "unreviewed", True), (2, 5, "b", "b", 1, "exact", "unreviewed", True), (3, 5, "c", "c", 1, "exact", "unreviewed", False)],
        "field_id long, letter_id long, value string, verbatim string, page_no int, validation string, review_status string, is_current boolean",
        "fields",
    )
    actions = kept(
        [(1, "corrected", "p", "A", "n", 1), (2, "verified", "p", None, "n", 1), (3, "verified", "p", None, "n", 1)],
        "field_id long, action string, actor string, new_value string, note string, acted_at long",
        "actions",
    )
    after, events = versions.apply_review(fields, actions)
    assert "Broadcast" not in plan_of(after) + plan_of(events)
    assert sum("Relation" in x and "verbatim#" in x for x in optimized(after).splitlines()) == 1
    assert {(r.field_id, r.value, r.review_status, r.is_current, r.superseded_by) for r in after.collect()} == {
        ("1", "a", "unreviewed", False, "1/corrected"),
        ("1/corrected", "A", "corrected", True, None),
        ("2", "b", "verified", True, None),
        ("3", "c", "unreviewed", False, None),
    }


def test_own_reference_does_not_move_on(spark, tmp_path):
    letters, _, found = tables(spark, tmp_path)
    direct = citations.apply_direct_rules(citations.distinct_citations(found), citations.link_targets(letters))
    outer = optimized(direct).split("Join LeftOuter")
    assert len(outer) >= 4
    assert "own_ref" not in outer[0] + outer[1]


def test_answers_are_written_where_their_rows_arrive(spark, tmp_path):
    letters, cited, _ = tables(spark, tmp_path)
    letters = letters.selectExpr("*", "1 AS page_from", "2 AS page_to", "'CTR' AS from_code", "'AE' AS to_code", "dated AS received", "'' AS chainage", "'' AS clause")
    files = bridge.extraction_files(letters, cited)
    lines = plan_of(files).splitlines()
    lists = [i for i, x in enumerate(lines) if "collect_list" in x]
    moves = [i for i, x in enumerate(lines) if "Exchange hashpartitioning(package_id" in x and "document_id" in x]
    assert max(lists) < min(moves)
    assert files.count() == 2
