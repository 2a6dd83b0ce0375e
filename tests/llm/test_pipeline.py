"""The pipeline against one written without Spark, stage by stage, on the smallest tables."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from missive.llm import contamination, near_dups, quality
from missive.llm.common import table

from test_secrets import plain

SF = "/root/testdata/sf0.001"


def components(prints):
    """Smallest id reached over fingerprints within four bits, by comparing all."""
    ids, values = list(prints), np.array(list(prints.values()), dtype=np.uint64)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            near = np.flatnonzero(np.bitwise_count(values ^ values[k]) <= near_dups.RADIUS)
            low = min(label[ids[j]] for j in near)
            for j in near:
                if label[ids[j]] != low:
                    label[ids[j]], changed = low, True
    return label


def masked(text):
    out, at = "", 0
    for _, start, end in plain(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    weights, offset = quality.fit(table(spark, SF, "documents").select("doc_id", "text"))
    shapes = quality.Shapes()
    stay = {}
    for i, text in docs.items():
        at, value = quality.features(shapes.buckets(text.split()))
        if text.split() and 1 / (1 + np.exp(-(value @ weights[at] + offset))) >= quality.KEEP_FROM:
            stay[i] = text
    assert 0 < len(stay) < len(docs)
    label = components({i: near_dups.simhash(t) for i, t in stay.items()})
    assert any(label[i] != i and stay[i] != stay[label[i]] for i in stay)
    stay = {i: t for i, t in stay.items() if label[i] == i}
    index = contamination.Index(items)
    stay = {i: masked(t) for i, t in stay.items() if not index.search(t)}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in entry.queries()["pipeline"](spark, SF).collect()}
    assert got.keys() == stay.keys()
    for i, text in stay.items():
        assert list(got[i].ids) == model.encode(text) and got[i].text == text and got[i].n_tokens == len(got[i].ids)


ROWS = [
    (1, "one two three four five six seven", "en", None, 5), (1, "one two three four five six seven", "en", None, 5),
    (2, None, None, "s", None), (None, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 1),
]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_takes_odd_rows(spark, name, stage):
    """Nulls, repeated rows, empty and long texts, no rows, further columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, keep string, print long, ids long"
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in ROWS], schema)
    for table_ in (docs, docs.limit(0)):
        found = stage(spark, table_, SF)
        assert found.count() <= table_.count()
        if stage is not corpus_pipeline.encode:
            assert found.columns == docs.columns


def test_near_duplicates_are_those_of_simhash_balls(spark):
    """Stage 2 keeps what the operator named for it keeps: texts are linked by their fingerprints, not by 0.8 of their shingles."""
    base = [f"word{k}" for k in range(60)]
    rows = [(1, " ".join(base)), (2, "other text of its own"), (3, " ".join(base).upper())]
    for k in range(60):
        rows.append((10 + k, " ".join([*base[:k], "changed", *base[k + 1 :]])))
    label = components({i: near_dups.simhash(t) for i, t in rows})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stay = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near-duplicates"](spark, docs, SF).collect()}
    assert stay == {i for i in label if label[i] == i}
    assert 3 not in stay and 2 in stay
