"""Prefix hashes: spans, extensions, edits, order of documents."""

import hashlib
import random

from missive.llm import prefix_hashes as ph
from missive.llm.queries import op7_prefix_hashes


def test_spans_and_extensions():
    rng = random.Random(8)
    for _ in range(100):
        a = "".join(rng.choices("ab🙂é", k=rng.randint(0, 30)))
        b = "".join(rng.choices("ab🙂é", k=rng.randint(0, 30)))
        x, y = ph.Prefixes(ph.code_points(a)), ph.Prefixes(ph.code_points(b))
        for _ in range(20):
            i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
            n = rng.randint(0, min(len(a) - i, len(b) - j))
            assert (x.span(i, i + n) == y.span(j, j + n)) == (a[i : i + n] == b[j : j + n])
            want = 0
            while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
                want += 1
            assert ph.common_extension(x, i, y, j) == want


def test_edited_fingerprint_without_reading_again():
    rng = random.Random(10)
    for _ in range(2000):
        t, u = ("".join(rng.choices("ab🙂é ", k=rng.choice([0, 1, 2, 3, 14, 15, 16, 17, 31, 32, 33, 34, 90]))) for _ in range(2))
        own, following = ph.Marked(ph.code_points(t)), ph.Marked(ph.code_points(u))
        assert own.edited_fingerprint(following) == ph.fingerprint(ph.edited(t, u))


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if min(len(a), len(b)) < 256:
        return 0.0
    pairs = [(a[len(a) - 256 + k : len(a) - 252 + k], b[len(b) - 256 + k : len(b) - 252 + k]) for k in range(0, 256, 4)]
    used = [p for p in pairs if p != ("....", "....")]
    return sum(x == y for x, y in used) / len(used) if used else 0.0


def test_likeness_against_plain_version(spark):
    rng = random.Random(11)
    marks = [ph.fingerprint("".join(rng.choices("abc", k=rng.choice([0, 3, 20, 400])))) for _ in range(60)]
    rows = [(rng.choice(marks), rng.choice(marks)) for _ in range(300)] + [("", marks[0]), ("x", "x")]
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", ph.likeness(spark_col("a"), spark_col("b")).alias("v")).collect()
    assert all(r.v == plain_likeness(r.a, r.b) for r in found)
    empty = spark.createDataFrame([(marks[0], None)], "a string, b string")
    assert empty.select(ph.likeness(spark_col("a"), spark_col("b")).alias("v")).first().v is None


def test_query_against_plain_version(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abcdefghij klmn🙂é", k=rng.choice([0, 1, 2, 5, 60, 400])))) for i in rng.sample(range(-500, 500), 60)]
    rows += [(1000, "x" * 50_000), (1001, None), (1002, ""), (1003, "same text"), (1003, "same text"), (None, "lost"), (None, "also lost")]
    spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, range string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_prefix_hashes(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        t, u = t or "", order[(k + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        want.append((str(i), len(t), hashlib.sha256(new.encode()).hexdigest(), ph.fingerprint(t), ph.fingerprint(new)))
    assert sorted((str(r[0]), *r[1:5]) for r in got) == sorted(want)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) >= (r.fingerprint == r.edited_fingerprint)
    long_ones = [r for r in got if r.n_chars >= 60 and r.doc_id != 1000]
    assert sum(r.near_edited > r.near_next for r in long_ones) >= 0.9 * len(long_ones)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "only one here")], "doc_id long, text string")
    row = ph.with_following(one).first()
    assert row.edited == "only on" + "only o" and row.next_fingerprint == row.fingerprint
    assert ph.with_following(one.limit(0)).count() == 0
    pair = spark.createDataFrame([("", "abc"), ("", "")], "a string, b string")
    marks = [(ph.fingerprint(r.a), ph.fingerprint(r.b)) for r in pair.collect()]
    like = spark.createDataFrame(marks, "a string, b string").select(ph.likeness(spark_col("a"), spark_col("b"))).collect()
    assert [r[0] for r in like] == [0.0, 1.0]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)
