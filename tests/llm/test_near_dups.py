"""Fingerprints and components against all pairs; both ways of linking."""

import random

import numpy as np
import pytest
import xxhash

from missive.llm import near_dups

from test_pipeline import components


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_equals_plain_version():
    rng = random.Random(3)
    signs = list("aAbB ÄéİK\t\n\x0b\x0c\r\x1c\x85  ") + ["word", "Word "]
    for _ in range(500):
        text = "".join(rng.choices(signs, k=rng.randint(0, 40)))
        assert near_dups.simhash(text) == plain_print(text), text
    assert near_dups.simhash("w " * 200_000) == plain_print("w w w w")


def planted(rng):
    """Random fingerprints, chains with steps of up to four bits, a crowd around one, and near misses."""
    values = [rng.getrandbits(64) for _ in range(60)] + [0]
    for base in values[:12]:
        x = base
        for _ in range(5):
            for b in rng.sample(range(64), rng.randint(3, 5)):
                x ^= 1 << b
            values.append(x)
    crowd = rng.getrandbits(64)
    values += [crowd ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(150)]
    values += [crowd ^ sum(1 << b for b in rng.sample(range(32), rng.randint(4, 8))) for _ in range(80)]
    return values + values[:5]


@pytest.mark.parametrize("crowd", [2, 8, 256])
def test_links_connect_exactly_what_is_near(spark, crowd):
    from missive.operators.threads import connected_components

    rng = random.Random(crowd)
    values = planted(rng)
    prints = {int(np.array(v, dtype=np.uint64).astype(np.int64)): v for v in values}
    frame = spark.createDataFrame([(p,) for p in prints], "print long")
    found = near_dups.links(frame, crowd)
    for r in found.collect():
        assert (prints[r.src] ^ prints[r.dst]).bit_count() <= 4 and r.src < r.dst
    got = connected_components(frame.withColumnRenamed("print", "id"), found)
    want = components({p: v for p, v in sorted(prints.items())})
    assert {r.id: r.component for r in got.collect()} == want


def test_documents(spark):
    base = " ".join(f"word{k}" for k in range(200))
    rows = [
        (5, base, "a"), (2, base + " more", "a"), (9, base.upper(), "a"), (7, None, "a"), (4, " \n", "a"), (None, base, "a"),
        (11, "other text entirely", "a"), (11, "other text entirely", "a"), (None, "alone here", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_dups.near_duplicates(docs).collect()), key=str)
    assert len(got) == len(rows)
    prints = {i: plain_print(t) for i, t, _ in rows}
    label = components({i: p for i, p in prints.items() if i is not None})
    for i, mark, component in got:
        if i is not None:
            assert mark == f"{prints[i]:016x}" and component == label[i]
    assert label[5] == label[2] == label[9] == 2 and label[4] == 4 == label[7]
    stay = near_dups.representatives(docs)
    assert stay.columns == docs.columns
    assert sorted(str(r.doc_id) for r in stay.collect()) == ["11", "2", "4", "None", "None"]
    assert near_dups.near_duplicates(docs.limit(0)).count() == 0


def test_no_table_is_broadcast(spark, tmp_path):
    """Spark takes the exploded balls for as small as their fingerprints, and a broadcast of them ends the driver."""
    rows = [(k, f"text {k % 40} of some words {k % 7} and more") for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    prints = near_dups.cut_lineage(near_dups.fingerprints(docs))
    for df in (near_dups.links(prints), near_dups.near_duplicates(docs), near_dups.representatives(docs)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
