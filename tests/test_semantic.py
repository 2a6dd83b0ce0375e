"""Vector search in lots and blocks against all pairs, whatever the bounds it starts with."""

import math
import random

import pytest

from missive.operators import search


@pytest.mark.parametrize("seeds, pivots, lot", [(2048, 32, 1000), (15, 4, 7), (3, 1, 1), (40, 40, 20)])
def test_nearest_equal_all_pairs(spark, monkeypatch, seeds, pivots, lot):
    monkeypatch.setattr(search, "SEEDS", seeds)
    monkeypatch.setattr(search, "PIVOTS", pivots)
    rng = random.Random(seeds)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, [2 * c for c in rows[5][1]]) for i in range(8)]  # the same direction many times
    odd = [(2000, None), (2001, [0.0] * 4), (2002, [math.nan] * 4), (2003, [1.0, None, 1.0, 1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in search.semantic_nearest(table, table.where("vec_id % 10 = 0"), 6, lot).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.similarity))

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)

    expected = {}
    for i, q in rows:
        if i % 10 == 0:
            best = sorted(((-cosine(q, v), j) for j, v in rows))[:6]
            expected[i] = [(rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert {q: sorted(x) for q, x in got.items()} == expected
    assert search.semantic_nearest(table.limit(0), table, 6).collect() == []
    assert search.semantic_nearest(table, table.limit(0), 6).collect() == []
