"""Quality from weak labels: labellers, expectation-maximisation over their votes, a hashed linear scorer.

Each labeller looks at one property of a text and votes 1 (good), -1 (bad) or 0. The votes of all documents are counted by
vote pattern, so expectation-maximisation works on a table whose size depends on the number of labellers only: it estimates
the share of good documents and, for each class, how often each labeller gives each vote, with labellers independent inside a
class. The posterior of its pattern is a document's label. A linear scorer over hashed word shapes is trained on these labels
from a bounded sample and applied to all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded, texts

LABELLERS = [
    "marks", "marked_words", "capitals", "capital_letters", "repeats", "few_words", "cells", "cell_lines", "sentences", "word_length"
]
# documents the scorer is trained on, at most about; the votes are counted over all documents
TRAIN_ROWS = 20_000
BUCKETS = 1 << 11
# the classes weigh alike in training; below one half, as losing a good text is worse than keeping a bad one
KEEP_FROM = 0.3
EM_ROUNDS = 200
KEPT_WORDS = 200_000
# signs of a word whose shape is one feature
LONGEST = 16

# belief before the votes are seen, and its weight as a share of all votes
BAD_ON_GOOD, BAD_ON_BAD, PRIOR = 0.002, 0.3, 0.5

MARKED = re.compile(r"\w[^\w\s]{2,}(?:\s|$)")
MARKS = re.compile(r"[^\w\s.,;:!?'\"()|/@+-]")
ENDS = re.compile(r"[.!?](?:\s|$)")
RUNS = re.compile(r"(.)\1+")


class _Signs(dict):
    """Letters become a or A, digits 0, other signs stay; filled as signs occur."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        self[code] = "A" if sign.isupper() else "a" if sign.isalpha() else "0" if sign.isdigit() else sign
        return self[code]


SHAPE = _Signs()


def votes(text: str, words: list[str]) -> list[int]:
    """One vote for each of LABELLERS; of each property there are two views, so that the labellers overlap."""
    n = len(words)
    if not n:
        return [0] * len(LABELLERS)

    def vote(value: float, good_to: float, bad_from: float) -> int:
        return 1 if value <= good_to else -1 if value >= bad_from else 0

    enough = n >= 20
    letters = sum(map(str.isalpha, text))
    lines = [line for line in text.split("\n") if line]
    found = [
        vote(len(MARKS.findall(text)) / n, 0.05, 0.5),
        vote(len(MARKED.findall(text)) / n, 0.02, 0.3),
        vote(sum(map(str.isupper, words)) / n, 0.1, 0.5),
        vote(sum(map(str.isupper, text)) / max(1, letters), 0.15, 0.5),
        vote(sum(map(str.__eq__, words, words[1:])) / n, 0.05, 0.3) if enough else 0,
        # long texts repeat common words; what counts is how few are left of each hundred
        vote(1 - sum(len(set(words[k : k + 100])) for k in range(0, n, 100)) / n, 0.45, 0.7) if enough else 0,
        vote(text.count("|") / n, 0.02, 0.2),
        vote(sum("|" in line for line in lines) / len(lines), 0.02, 0.5),
        vote(n / (1 + len(ENDS.findall(text))), 40, 150) if enough else 0,
        (1 if 3 <= len(text) / n <= 14 else -1 if len(text) / n > 25 else 0) if enough else 0,
    ]
    return found


def estimate(patterns: list[tuple[int, ...]], counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good for each pattern, share of good, and bad[class, labeller]: how often a labeller that votes says bad.

    Class 1 is good. A labeller that does not vote says nothing. Bad texts are bad in different ways, so labellers that look
    at different properties disagree on them, and without more knowledge the classes could settle on one kind of bad text.
    The prior says that a bad vote on a good text is rare (BAD_ON_GOOD) and weighs as much as PRIOR of all votes.
    """
    v = np.array(patterns, dtype=np.int64).reshape(len(patterns), -1)
    says_bad, says = (v < 0).astype(float), (v != 0).astype(float)
    good = np.where((v < 0).any(axis=1), 0.3, 0.9)
    share, bad = 0.5, np.zeros((2, v.shape[1]))
    strength = PRIOR * (counts @ says) + 1
    for _ in range(rounds):
        weights = np.stack([counts * (1 - good), counts * good])
        share = float((weights[1].sum() + 1) / (weights.sum() + 2))
        mean = np.array([[BAD_ON_BAD], [BAD_ON_GOOD]])
        own = strength * np.array([[1 - share], [share]])
        bad = (weights @ says_bad + own * mean) / (weights @ says + own)
        logs = says_bad @ np.log(bad).T + (says - says_bad) @ np.log(1 - bad).T + np.log([1 - share, share])
        fresh = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(fresh - good).max(initial=0) < 1e-9:
            break
        good = fresh
    return good, share, bad


class Shapes:
    """Hashed shapes of words and of neighbouring words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    @staticmethod
    def shape(word: str) -> str:
        """Letters as a or A, digits as 0, runs of one sign shortened to two."""
        return RUNS.sub(r"\1\1", word.translate(SHAPE))

    @staticmethod
    def _bucket(line: str) -> int:
        return zlib.crc32(line.encode()) % (BUCKETS // 2)

    def buckets(self, words: list[str]) -> np.ndarray:
        """Buckets of all features of a text; the first half holds shapes, the second pairs. Long words count in parts."""
        if max(map(len, words), default=0) > LONGEST:
            words = [word[k : k + LONGEST] for word in words for k in range(0, len(word), LONGEST)]
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            known[word] = self._bucket(self.shape(word))
        own = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        same = np.fromiter(map(str.__eq__, words, words[1:]), dtype=np.int64, count=max(0, len(words) - 1))
        pairs = (own[:-1] * 31 + own[1:] * 7 + same * 101 + 13) % (BUCKETS // 2) + BUCKETS // 2
        return np.concatenate([own, pairs])


def features(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their weights, the root of their share."""
    found, counts = np.unique(buckets, return_counts=True)
    return found, np.sqrt(counts / max(1, counts.sum()))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic scorer for soft labels, by gradient steps with momentum; the classes count alike."""
    dense = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for k, (at, value, _) in enumerate(rows):
        dense[k, at] = value
    label = np.array([r[2] for r in rows], dtype=np.float32)
    weight = np.where(label > 0.5, 0.5 / max(1, (label > 0.5).sum()), 0.5 / max(1, (label <= 0.5).sum())).astype(np.float32)
    w, offset = np.zeros(BUCKETS, dtype=np.float32), np.float32(0)
    speed, pull = np.zeros_like(w), np.float32(0)
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-np.clip(dense @ w + offset, -60, 60))) - label)
        speed = 0.9 * speed - 4.0 * (error @ dense + 1e-4 * w)
        pull = 0.9 * pull - 4.0 * error.sum()
        w, offset = w + speed, offset + pull
    return w, float(offset)


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 1):
        found = [votes(t, t.split()) for t in batch.column(1).to_pylist()]
        lists = pa.array(found, pa.list_(pa.int8()))
        yield pa.RecordBatch.from_arrays([lists], ["votes"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in bounded(batches, 1):
        cast, at, value = [], [], []
        for text in batch.column(1).to_pylist():
            words = text.split()
            found = features(shapes.buckets(words))
            cast.append(votes(text, words))
            at.append(found[0].astype(np.int32))
            value.append(found[1].astype(np.float32))
        columns = [batch.column(0), pa.array(cast, pa.list_(pa.int8())), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "votes", "at", "value"])


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """The scorer for `docs` (doc_id, text). Votes are counted over all rows, training takes a sample by hash of doc_id and text."""
    counted = (
        docs.select("doc_id", "text").mapInArrow(_examine, "votes array<tinyint>").groupBy("votes").count()
    ).collect()  # the patterns that occur, at most 3 ** len(LABELLERS) and in practice some hundreds
    counted.sort(key=lambda r: tuple(r.votes))
    patterns, counts = [tuple(r.votes) for r in counted], np.array([r["count"] for r in counted], dtype=float)
    if not patterns:
        return np.zeros(BUCKETS), 0.0
    good, _, _ = estimate(patterns, counts)
    posterior = dict(zip(patterns, good))
    # one in `step` rows
    step = max(1, round(counts.sum() / train_rows))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0)
    rows = sample.select("doc_id", "text").mapInArrow(_sampled, "doc_id long, votes array<tinyint>, at array<int>, value array<float>").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, tuple(r.at), tuple(r.value)))
    chosen = [(np.array(r.at), np.array(r.value), posterior[tuple(r.votes)]) for r in rows if any(r.votes)]
    if not chosen or min(p[2] for p in chosen) > 0.5 or max(p[2] for p in chosen) <= 0.5:
        # one class only: nothing to tell apart
        return np.zeros(BUCKETS), 4.0 if not chosen or chosen[0][2] > 0.5 else -4.0
    return train(chosen)


def _scores(column: pa.Array, shapes: Shapes, weights: np.ndarray, offset: float) -> np.ndarray:
    out = np.zeros(len(column))
    for k, text in enumerate(column.to_pylist()):
        words = (text or "").split()
        if words:
            at, value = features(shapes.buckets(words))
            out[k] = 1 / (1 + np.exp(-np.clip(value @ weights[at] + offset, -60, 60)))
    return out


def scored(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, quality_score (0 to 1), keep (score of KEEP_FROM or more) for every row.

    Labels are not used. A text without words, missing texts among them, has score 0 and is rejected. Repeated rows have the
    same score; missing identifiers are carried along; columns besides the two are left out; no rows give no rows. Whole
    texts count, however long.
    """
    rows = texts(docs, id_col, text_col)
    weights, offset = fit(rows, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in bounded(batches, 1):
            scores = _scores(batch.column(1), shapes, weights, offset)
            columns = [batch.column(0), pa.array(scores), pa.array(scores >= KEEP_FROM)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "quality_score", "keep"])

    return rows.mapInArrow(run, "doc_id long, quality_score double, keep boolean")


def kept(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all their columns, that `scored` keeps."""
    weights, offset = fit(texts(docs, id_col, text_col), train_rows)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in bounded(batches, place):
            yield batch.filter(pa.array(_scores(batch.column(place), shapes, weights, offset) >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)
