"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers the case, maps letters of other scripts that look like Latin ones to these, and turns every other sign into a
blank; a text in which digits or signs touch letters is also matched with these read as the letters they stand for. The
lexicon has whole words and beginnings of words with their log odds of standing in a toxic text; both it and the exception
phrases, in which a lexicon word does no harm, are learnt from labelled rows. A score depends on the weights of all matches
and on their share of the text's words, through a logistic curve fitted on labelled rows that the lexicon has not seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded, texts

# labelled rows used for learning, at most about; they are joined by broadcast, which this bounds
TRAIN_ROWS = 20_000
LEXICON_SIZE = 5_000
EXCEPTIONS_SIZE = 1_000
# toxic texts an entry stands in: this many, and this share of them
LEAST_DOCS, LEAST_SHARE = 5, 0.01
LEAST_ODDS = 3.5
BEGINNINGS = range(3, 9)
FOLDS = 5

# Letters that look like Latin ones, and what digits and signs stand for.
HOMOGLYPHS = dict(zip("аеорсухкмтнвіјѕԁɡһոԛԝαεορτυνικχ", "aeopcyxkmthbijsdghnqwaeoptuvikx"))
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
DISGUISED = re.compile(r"[^\W\d_][0134578@$!|€]|[0134578@$!|€][^\W\d_]")
MARKS_BEHIND = re.compile(r"[@$!|€]+(?!\w)")


class _Fold(dict):
    def __init__(self, signs: dict[str, str]) -> None:
        super().__init__({ord(k): v for k, v in {**HOMOGLYPHS, **signs}.items()})

    def __missing__(self, code: int) -> str:
        # full-width forms lie at a fixed distance from ASCII
        sign = chr(code - 0xFEE0) if 0xFF21 <= code <= 0xFF5A else chr(code)
        self[code] = sign.lower()[:1] if sign.isalpha() else " "
        return self[code]


PLAIN, READ = _Fold({}), _Fold(STANDS_FOR)


def folded(text: str) -> list[str]:
    """The readings of a text, words between single or several blanks, a blank at either end."""
    lower = text.lower()
    readings = [f" {lower.translate(PLAIN)} "]
    if DISGUISED.search(lower):
        # signs at the end of a word are marks, not letters
        readings.append(f" {MARKS_BEHIND.sub(' ', lower).translate(READ)} ")
    return readings


def entries(text: str) -> set[str]:
    """Whole words (with a blank behind) and beginnings of a text's words, a blank before each."""
    found = set()
    for reading in folded(text):
        for word in set(reading.split()):
            found.add(f" {word} ")
            found.update(f" {word[:k]}" for k in BEGINNINGS if len(word) > k)
    return found


class Matcher:
    """Finds lexicon entries outside exception phrases."""

    def __init__(self, lexicon: dict[str, float], exceptions: Iterable[str] = ()) -> None:
        self.machine = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            # a one may stand for l as for i
            for spelling in {entry, entry.replace("l", "i")}:
                if spelling == entry or spelling not in lexicon:
                    self.machine.add_word(spelling, (len(spelling), weight))
        for phrase in exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.empty = len(self.machine) == 0
        if not self.empty:
            self.machine.make_automaton()

    def hits(self, reading: str) -> dict[int, float]:
        """Weight of the best entry at each matched word, by the position of the blank before it."""
        if self.empty:
            return {}
        found: dict[int, float] = {}
        spared = []
        for end, (length, weight) in self.machine.iter(reading):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            else:
                found[start] = max(weight, found.get(start, 0.0))
        if spared:
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in spared)}
        return found

    def measures(self, text: str) -> list[float]:
        """Total weight, and weight by words, of the reading that has most, on a log scale; zero for an empty text."""
        best, words = 0.0, 1
        for reading in folded(text):
            total = sum(self.hits(reading).values())
            if total > best:
                best, words = total, len(reading.split())
        return [float(np.log1p(best)), float(np.log1p(100 * best / (words + 20)))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, train_rows: int) -> DataFrame:
    """doc_id, text, toxic, fold of a bounded sample of labelled rows outside the held-out ones, each text once."""
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .withColumn("fold", (F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int"))
    )
    step = max(1, -(-known.count() // train_rows))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    return docs.join(F.broadcast(sample), "doc_id")


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches, 0, 1 << 22):
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (toxic if label else clean).update(entries(text))
        both = list(toxic.keys() | clean.keys())
        columns = [pa.array(both, pa.string()), *(pa.array([c[e] for e in both], pa.int64()) for c in (toxic, clean))]
        yield pa.RecordBatch.from_arrays(columns, ["entry", "toxic", "clean"])


def _learn_lexicon(rows: DataFrame) -> dict[str, float]:
    sizes = rows.groupBy("toxic").count().collect()
    n = {r.toxic: r["count"] for r in sizes}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 1) / (clean + 2))
    best = (
        rows.select("text", "toxic")
        .mapInArrow(_count_entries, "entry string, toxic long, clean long")
        .groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * toxic))
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("odds"), "entry")
        .limit(LEXICON_SIZE)
    )
    return {r.entry: float(r.odds) for r in best.collect()}


def _learn_exceptions(rows: DataFrame, lexicon: dict[str, float]) -> list[str]:
    """Phrases of a lexicon word and a neighbour that stand in several clean texts and in no toxic one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in bounded(batches, 0):
            lines = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                phrases = set()
                for reading in folded(text):
                    for start in matcher.hits(reading):
                        before, after = reading[:start].rsplit(maxsplit=1)[-1:], reading[start:].split(maxsplit=2)[:2]
                        phrases.add(" ".join(before + after[:1]))
                        phrases.add(" ".join(after))
                lines += [(p, label) for p in phrases if " " in p]
            if lines:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*lines), (pa.string(), pa.int32()))], ["phrase", "toxic"]
                )

    found = (
        rows.select("text", "toxic")
        .mapInArrow(run, "phrase string, toxic int")
        .groupBy("phrase")
        .agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n"))
        .where("toxic = 0 AND n >= 3")
        .orderBy(F.desc("n"), "phrase")
        .limit(EXCEPTIONS_SIZE)
    )
    return [r.phrase for r in found.collect()]


def _measured(rows: DataFrame, lexicon: dict[str, float], exceptions: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon, exceptions)
        for batch in bounded(batches, 1):
            found = [matcher.measures(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "weight", "density", *batch.schema.names[2:]])

    more = "".join(f", {n} {t}" for n, t in rows.dtypes[2:])
    return rows.mapInArrow(run, f"doc_id long, weight double, density double{more}")


def _curve(rows: list, steps: int = 60) -> list[float]:
    """Logistic coefficients (offset, weight, density) by Newton steps with a little shrinkage."""
    x = np.array([[1.0, r.weight, r.density] for r in rows]).reshape(-1, 3)
    y = np.array([r.toxic for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return [float(np.clip(10 * (y.mean() if len(y) else 0.0) - 5, -5, 5)), 0.5, 0.5]
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - ridge @ beta
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge, slope).clip(-2, 2)
    return beta.tolist()


def scored(
    docs: DataFrame,
    labels: DataFrame,
    train_rows: int = TRAIN_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5) for every row of `docs`.

    Learns only from labelled rows that are not held out: three of four folds give lexicon and exceptions, the fourth the
    curve. Rows with a missing label or identifier teach nothing; a document labelled twice is toxic if one label says so.
    Missing texts count as empty and, like texts without matches, get the curve's lowest score; repeated rows have the same
    score; missing identifiers are carried along and not held out; columns besides the named are left out; without labels
    nothing is known and every score is below one half. Whole texts are matched, however long.
    """
    rows = texts(docs, id_col, text_col)
    sample = _labelled(rows, labels, id_col, label_col, train_rows)
    first, second = sample.where("fold <> 4").dropDuplicates(["text"]), sample.where("fold = 4")
    lexicon = _learn_lexicon(first)
    exceptions = _learn_exceptions(first, lexicon) if lexicon else []
    known = _measured(second.select("doc_id", "text", "toxic"), lexicon, exceptions).collect()  # at most train_rows
    known.sort(key=lambda r: (r.doc_id, r.weight, r.density))
    offset, by_weight, by_density = _curve(known)
    line = offset + by_weight * F.col("weight") + by_density * F.col("density")
    score = 1 / (1 + F.exp(-line))
    return (
        _measured(rows, lexicon, exceptions)
        .withColumn("score", score)
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
    )
