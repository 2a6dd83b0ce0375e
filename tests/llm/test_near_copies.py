"""Near copies by exact similarity against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from missive.llm import near_copies
from missive.llm.contamination import shingles, words_of


def alike(a, b):
    x, y = Counter(shingles(words_of(a))), Counter(shingles(words_of(b)))
    return x == y or 5 * sum((x & y).values()) >= 4 * sum((x | y).values())


def lowest(docs):
    """Smallest id reached over all similar pairs."""
    label = {i: i for i in docs}
    pairs = [(i, j) for i in docs for j in docs if i < j and alike(docs[i], docs[j])]
    while any(label[i] != label[j] for i, j in pairs):
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label, pairs


def planted():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(900)]
    docs = {}
    for group in range(12):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 150, 400]))
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs[len(docs)] = " ".join(text)
    line = " ".join(rng.choices(vocabulary, k=60))
    for k in range(12):
        docs[len(docs)] = f"{line} {' '.join(rng.choices(vocabulary, k=rng.randint(1, 30)))}"
    for text in ("", "One two", "one  TWO!", "word " * 200, "word " * 170, "word " * 100):
        docs[len(docs)] = text
    return docs


@pytest.mark.parametrize("crowd", [2, 64])
def test_components_equal_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_copies.links, "__defaults__", (near_copies.SHINGLE, near_copies.LEAST, crowd))
    docs = planted()
    label, pairs = lowest(docs)
    got = near_copies.near_copies(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == label and len(got) == len(docs) and len(pairs) > 50


def test_counts_never_rule_out_a_similar_pair():
    rng = random.Random(3)
    passed = 0
    for _ in range(300):
        a = [rng.getrandbits(40) for _ in range(rng.choice([1, 5, 60, 700, 4000]))]
        b = rng.sample(a, rng.randint(0, len(a))) + [rng.getrandbits(40) for _ in range(rng.randint(0, len(a)))]
        sets = [np.array(sorted(set(x)), dtype=np.int64) for x in (a, b)]
        common = len(set(a) & set(b))
        bound = near_copies.most_shared(*map(near_copies._counts, sets))
        assert bound >= common
        passed += bound * 9 >= 4 * (len(sets[0]) + len(sets[1])) > 0
    assert 0 < passed < 200
    assert near_copies.most_shared(near_copies._counts(np.zeros(300, dtype=np.int64)), b"") > 300


def test_shared_sentences_move_few_sets(spark, monkeypatch):
    """Texts made of common sentences, no two similar: hardly a pair is left for whole sets."""
    rng = random.Random(5)
    sentences = [" ".join(f"s{k}w{rng.randrange(9999)}" for _ in range(12)) for k in range(40)]
    rows = [(i, " ".join(rng.sample(sentences, 10))) for i in range(500)]
    left = []
    plausible = near_copies._plausible

    def counted(*args):
        found = near_copies.cut_lineage(plausible(*args))
        left.append((args[0].count(), found.count()))
        return found

    monkeypatch.setattr(near_copies, "_plausible", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label, _ = lowest(dict(rows))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == label
    assert sum(n for n, _ in left) > 200 and sum(m for _, m in left) < sum(n for n, _ in left) / 5


def test_representatives_drop_similar_texts_only(spark):
    docs = planted()
    label, _ = lowest(docs)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    stay = {r.doc_id for r in near_copies.representatives(rows).collect()}
    assert stay == {i for i in docs if label[i] == i}
