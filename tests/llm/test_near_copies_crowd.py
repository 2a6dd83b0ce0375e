"""A large group of near copies of which few are similar to the first: not all pairs are compared."""

import random

from missive.llm import near_copies

from test_near_copies import lowest


def test_crowd_is_joined_without_all_pairs(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"w{k}" for k in range(300)]
    docs = {}
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(2, 59), rng.choices([2, 3, 4], [1, 3, 6])[0]):
            text[at * 5] = f"x{i}y{at}"
        docs[i] = " ".join(text)
    label, pairs = lowest(docs)
    seen = []
    plausible = near_copies._plausible

    def counted(found, *args):
        seen.append(found.count())
        return plausible(found, *args)

    monkeypatch.setattr(near_copies, "_plausible", counted)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(rows).collect()} == label
    assert len(set(label.values())) < 5 and len(pairs) < 20_000
    assert sum(seen) < 15_000, seen  # all pairs: 44,850
