"""Packages compared whole in one task against the join by grams, and what a step leaves on disk."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from missive.operators import citations
from missive.session import SHUFFLE_CLEANUP, cut_lineage

from test_growing_joins import plan_of
from test_operators import brute_force_nearest


def references(rng, n):
    return [f"{rng.choice(['CTR', 'AE'])}/PKG{rng.randint(1, 2)}/202{rng.randint(0, 1)}/{rng.randint(0, 120):05d}" for _ in range(n)]


@pytest.mark.parametrize("whole, cells", [(10**6, 1 << 17), (10**6, 7), (150, 1 << 17), (0, 1 << 17)])
def test_both_ways_find_the_same_letters(spark, whole, cells, monkeypatch):
    monkeypatch.setattr(citations, "WHOLE", whole)
    monkeypatch.setattr(citations, "CELLS", cells)
    rng = random.Random(5)
    held = {p: dict(enumerate(references(rng, n))) for p, n in ((1, 60), (2, 200))}
    cited = {p: set(references(rng, 30)) | {"", "///", "ÄÖ 12"} for p in held}
    targets = spark.createDataFrame(
        [(p, i, i, ref) for p, refs in held.items() for i, ref in refs.items()], "package_id long, letter_id long, serial long, ref string"
    )
    wanted = spark.createDataFrame([(p, ref) for p, refs in cited.items() for ref in refs], "package_id long, ref string")
    got = {}
    for r in sorted(citations.nearest_letters(wanted, targets).collect(), key=lambda r: (-round(r.score, 6), not r.same_serial, r.serial)):
        got.setdefault((r.package_id, r.cited_ref), []).append(r.letter_id)
    want = {(p, k): v for p in held for k, v in brute_force_nearest(cited[p], held[p], citations.BEST + 1).items() if v}
    assert got == want


@pytest.mark.parametrize("whole", [0, 10**6])
def test_repeated_and_missing_rows(spark, whole, monkeypatch):
    """Citations and letters that come twice, without letter, package or reference."""
    monkeypatch.setattr(citations, "WHOLE", whole)
    targets = spark.createDataFrame(
        [(1, 10, 1, "A/2020/0001"), (1, 10, 1, "A/2020/0001"), (1, 11, 2, "A/2020/0002"), (1, None, 3, "A/2020/0003"),
         (None, 12, 4, "A/2020/0004"), (1, 13, None, "A/2020/0005"), (2, 14, 1, "A/2020/0001")],
        "package_id long, letter_id long, serial long, ref string",
    )
    asked = spark.createDataFrame(
        [(1, 10, "A/2020/0009"), (1, 20, "A/2020/0009"), (1, 20, "A/2020/0009"), (1, None, "A/2020/0009"), (None, 12, "A/2020/0009"),
         (1, 30, "A/2020/0002"), (2, 14, "A/2020/0001")],
        "package_id long, citing_letter_id long, cited_ref_normalized string",
    )
    found = sorted((r.package_id, r.citing_letter_id, r.place, r.candidate_letter_id, r.match_score, r.same_serial)
                   for r in citations.fuzzy_candidates(asked, targets).collect())
    got = {}
    for package, letter, place, candidate, score, same in found:
        got.setdefault((package, letter), []).append((place, candidate, round(score, 6), same))
    assert set(got) == {(1, 10), (1, 20), (1, 30)}
    assert [x[1] for x in got[1, 10]] == [13, 11]
    assert [x[1] for x in got[1, 20]] == [13, 13, 10]
    assert [x[1:] for x in got[1, 30]][0] == (11, 1.0, True)


def test_references_move_without_their_grams(spark):
    targets = spark.createDataFrame([(1, 1, 1, "A/2020/0001")], "package_id long, letter_id long, serial long, ref string")
    asked = spark.createDataFrame([(1, 2, "A/2020/0009")], "package_id long, citing_letter_id long, cited_ref_normalized string")
    lines = plan_of(citations.fuzzy_candidates(cut_lineage(asked), cut_lineage(targets))).splitlines()
    grams = [i for i, x in enumerate(lines) if "array_distinct" in x]
    moves = [i for i, x in enumerate(lines) if "Exchange " in x]
    assert len(moves) == 1 and grams and max(grams) < moves[0]


def test_a_cut_lineage_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {os.path.basename(files.apply(i).getName()) for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(SHUFFLE_CLEANUP, None)
    moved = spark.range(1000).repartition(3, F.col("id") % 7)
    kept = cut_lineage(moved)
    until = time.time() + 30
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert kept.count() == 1000 and len(moved.collect()) == 1000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
