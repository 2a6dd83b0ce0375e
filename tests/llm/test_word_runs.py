"""Periodic runs of words against a comparison of every word with every other place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from missive.llm import word_runs
from missive.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, times=4):
    """Every period, every stretch; the smallest period of a stretch wins."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    s = np.array([number[w] for w in words], dtype=np.int64)
    best = {}
    for q in range(1, len(s) // 2 + 1):
        equal = np.concatenate([[0], s[:-q] == s[q:], [0]]).astype(np.int8)
        step = np.diff(equal)
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if b - a >= q:
                best.setdefault((a, b - a + q), q)
    return sorted((a, n, q) for (a, n), q in best.items() if n >= max(least, times * q))


def plain_kept(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def made(rng):
    letters, size, out = rng.choice([1, 2, 3, 6, 60]), rng.choice([0, 1, 5, 12, 60, 300, 900]), []
    while len(out) < size:
        kind = rng.randrange(4)
        if kind == 0:
            out += [rng.randrange(letters) for _ in range(rng.randint(1, 40))]
        elif kind == 1:
            out += [rng.randrange(letters) for _ in range(rng.randint(1, 90))] * rng.randint(1, 9)
        elif kind == 2:
            # a period that is itself nearly all repetition
            out += ([rng.randrange(letters)] * rng.randint(1, 50) + [rng.randrange(letters)]) * rng.randint(1, 8)
        else:
            a, b = [0, 1], [0]
            for _ in range(rng.randint(1, 8)):
                a, b = a + b, a
            out += a * rng.randint(1, 5)
    return [f"é{x}" for x in out[:size]]


@pytest.mark.parametrize("least, times", [(6, 4), (3, 3), (20, 5)])
def test_runs_equal_plain_comparison(spark, least, times):
    rng = random.Random(least)
    texts = [" ".join(made(rng)) for _ in range(150)] + [None, "", " \t\n", "a", "b b b b b b", "x y " * 9]
    rows = [(k, t, "extra", "runs") for k, t in enumerate(texts)] + [(None, "c d " * 8, "extra", "runs"), (3, texts[3], "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, runs string").repartition(5)
    got = word_runs.word_runs(docs, least, times).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    expected = []
    for k, text, *_ in rows:
        words = words_of(text)
        found = plain_runs(words, least, times)
        expected.append((k, len(words), found, " ".join(plain_kept(words, found))))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in got], key=key) == sorted(expected, key=key)
    assert sum(len(x[2]) for x in expected) > 100
    assert word_runs.word_runs(docs.limit(0)).collect() == []


def test_long_texts_take_time_in_proportion(spark):
    """One word 300,000 times, Fibonacci words, a long period, and a text full of short runs."""
    rng = random.Random(2)
    a, b = ["x", "y"], ["x"]
    while len(a) < 200_000:
        a, b = a + b, a
    long = [str(rng.randrange(9)) for _ in range(50_000)]
    texts = [["w"] * 300_000, a, long * 4, [w for k in range(30_000) for w in [str(k % 7)] * 6]]
    rows = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in word_runs.word_runs(rows).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 300_000, 1)] and got[0].text == "w"
    assert [tuple(x) for x in got[2].runs if x.period == 50_000] == [(0, 200_000, 50_000)]
    assert sum(x.period == 1 and x.length == 6 for x in got[3].runs) == 30_000
    assert got[1].runs == []  # no four periods in a Fibonacci word


def test_query_equals_plain_version(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in QUERIES["op13_word_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    changed = 0
    for row in docs:
        words = words_of(row["text"])
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        found = plain_runs(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        listing = "".join(f"{a},{m},{q}\n" for a, m, q in sorted(found, key=lambda r: (r[0], r[2])))
        kept = " ".join(plain_kept(words, found))
        r = got[row["doc_id"]]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256(listing.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert changed > 10
