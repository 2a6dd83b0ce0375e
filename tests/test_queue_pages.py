"""Pages of the ambiguity queue: walked to the end against the whole queue, and one reference that very many share."""

import random

from pyspark.sql import functions as F

from missive.operators import citations, register

LETTERS = "package_id long, letter_id long, letter_ref string, serial long, is_current boolean, is_voided boolean, extra string"
LINKS = "package_id long, citing_letter_id long, cited_ref_normalized string, cited_ref_text string, resolution string, rule string"
SCORED = "package_id long, citing_letter_id long, cited_ref_normalized string, candidate_letter_id long, match_method string, match_score double"
EXACT = "package_id long, cited_ref_normalized string, candidate_letter_id long"
AFTER = "package_id long, serial int, cited_ref_text string"


def test_pages_make_up_the_queue(spark):
    rng = random.Random(3)
    letters = [(i % 2, i, f"L{i}", i // 2, rng.random() < 0.9, rng.random() < 0.1, "x") for i in range(60)]
    links, scored, exact = [], [], []
    for p in (0, 1):
        own = [r[1] for r in letters if r[0] == p]
        for n in range(4):
            exact += [(p, f"R{n}", i) for i in rng.sample(own, 2 + 3 * n)]
        for i in own:
            for n in range(4):
                if rng.random() < 0.4:
                    links.append((p, i, f"R{n}", f"r {n}", "unresolved_ambiguous", "exact_many"))
            if rng.random() < 0.5:
                links.append((p, i, f"S{i}", f"s {i}", rng.choice(["unresolved_ambiguous", "resolved"]), rng.choice(["fuzzy_many", None])))
                scored += [(p, i, f"S{i}", j, "trgm_fuzzy", rng.choice([0.6, 0.7])) for j in rng.sample(own, rng.randrange(4))]
    tables = [
        spark.createDataFrame(rows, schema).cache()
        for rows, schema in ((links, LINKS), (scored, SCORED), (exact, EXACT), (letters, LETTERS))
    ]
    whole = register.ambiguity_queue(tables[0], citations.candidate_rows(*tables[:3]), tables[3]).collect()
    expected = {}
    for r in whole:
        # one queue entry per citing letter and printed reference
        found = expected.setdefault((r.package_id, r.citing_serial, r.cited_ref_text), [])
        if r.candidate_letter_id is not None:
            found.append((-(r.match_score or 0), r.candidate_serial, r.candidate_letter_id, r.match_method))
    got, after, pages = {}, spark.createDataFrame([(0, None, None), (None, 5, "x")], AFTER), 0
    while rows := register.queue_page(*tables, after, size=17, shown=3).collect():
        pages += 1
        last = {}
        for r in sorted(rows, key=lambda r: (r.package_id, r.place)):
            assert (r.package_id, r.citing_serial, r.cited_ref_text) not in got
            got[r.package_id, r.citing_serial, r.cited_ref_text] = r
            last[r.package_id] = (r.package_id, r.citing_serial, r.cited_ref_text)
        # packages at their end stay there
        ends = {**{k[0]: k for k in sorted(got)}, **last}
        after = spark.createDataFrame([*ends.values(), (0, 0, "a")], AFTER)
        assert pages < 20
    assert pages > 1 and got.keys() == expected.keys()
    for key, r in got.items():
        best = sorted(expected[key])
        assert r.n_candidates == len(best)
        assert [(c.candidate_letter_id, c.match_method) for c in r.candidates] == [(b[2], b[3]) for b in best[:3]]
    empty = [t.limit(0) for t in tables]
    assert register.queue_page(*empty, after).collect() == []


def test_reference_of_two_thousand_letters(spark):
    ids = spark.range(2000)
    letters = ids.select(
        F.lit(1).alias("package_id"), F.col("id").alias("letter_id"), F.lit("R").alias("letter_ref"), F.col("id").alias("serial"),
        F.lit(True).alias("is_current"), F.lit(False).alias("is_voided"),
    )
    links = ids.selectExpr(
        "1 AS package_id", "id AS citing_letter_id", "'R' AS cited_ref_normalized", "'r' AS cited_ref_text",
        "'unresolved_ambiguous' AS resolution", "'exact_many' AS rule",
    )
    exact = ids.selectExpr("1 AS package_id", "'R' AS cited_ref_normalized", "id AS candidate_letter_id")
    after = spark.createDataFrame([(1, 99, "r")], AFTER)
    rows = register.queue_page(links, spark.createDataFrame([], SCORED), exact, letters, after, size=4, shown=2).collect()
    assert [(r.citing_serial, r.n_candidates, [c.candidate_letter_id for c in r.candidates]) for r in sorted(rows, key=lambda r: r.place)] == [
        (100 + i, 1999, [0, 1]) for i in range(4)
    ]
