"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every position, the hash of what stands before it: the sum of code point times power
of a base, modulo a prime. The hash of any span is a difference of two entries moved to position zero by an inverse power, so
spans are compared without reading them, and the longest common extension of two positions is found by binary search. Two
primes are used together.

A fingerprint is the number of code points, the hash of the whole text, and a sketch of its spans: every span of up to WIDTH
code points that ends at a position is hashed, and of each of BINS classes of hashes the lowest one is kept. The share of
classes in which two sketches agree estimates the share of spans that the texts have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded, evenly_dealt, id_bounds, partitions, range_bucket, texts

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WIDTH = 16
BINS = 64
DIGITS = 4
EMPTY = "." * DIGITS


class _Powers:
    """Powers of a base modulo a prime, grown as texts need them."""

    def __init__(self, base: int, prime: int) -> None:
        self.base, self.prime, self.table = base, prime, np.ones(1, dtype=np.int64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            step = pow(self.base, len(self.table), self.prime)
            self.table = np.concatenate([self.table, self.table * step % self.prime])
        return self.table[:n]


_UP = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]
_DOWN = [_Powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)


class Prefixes:
    """Prefix arrays of one text."""

    def __init__(self, codes: np.ndarray) -> None:
        self.n = len(codes)
        # sums stay below 2**63 up to 2**32 code points
        self.sums = [
            np.concatenate([[0], np.cumsum((codes + 1) * up.upto(self.n) % up.prime) % up.prime]) for up in _UP
        ]

    def spans(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One number for each span; equal spans have equal numbers wherever they stand."""
        high, low = (
            (sums[ends] - sums[begins]) % down.prime * down.upto(self.n + 1)[begins] % down.prime
            for sums, down in zip(self.sums, _DOWN)
        )
        return (high.astype(np.uint64) << np.uint64(31)) | low.astype(np.uint64)

    def span(self, begin: int, end: int) -> int:
        return int(self.spans(np.array([begin]), np.array([end]))[0])


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common run of code points from position i of one text and j of the other."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        half = (low + high + 1) // 2
        if a.span(i, i + half) == b.span(j, j + half):
            low = half
        else:
            high = half - 1
    return low


class Marked:
    """Prefix arrays of a text and the mixed hash of the span that ends at each of its positions."""

    def __init__(self, codes: np.ndarray, first: int = 0) -> None:
        """Spans that end at or before position `first` are left out."""
        self.codes, self.prefixes, self.n = codes, Prefixes(codes), len(codes)
        ends = np.arange(first + 1, self.n + 1)
        begins = np.maximum(ends - WIDTH, 0)
        mixed = self.prefixes.spans(begins, ends) ^ ((ends - begins).astype(np.uint64) << np.uint64(58))
        for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(factor)
        self.mixed = mixed ^ (mixed >> np.uint64(32))

    def fingerprint(self) -> str:
        return _written(self.n, self.prefixes.span(0, self.n), self.mixed)

    def edited_fingerprint(self, following: Marked) -> str:
        """Fingerprint of the text whose last half is replaced by the begin of the following one.

        Equal spans have equal hashes wherever they stand, so only spans across the seam are hashed anew.
        """
        kept = self.n - self.n // 2
        taken = min(self.n // 2, following.n)
        low = max(0, kept - (WIDTH - 1))
        seam = Marked(np.concatenate([self.codes[low:kept], following.codes[: min(taken, WIDTH - 1)]]), kept - low)
        whole = 0
        for own, other, up in zip(self.prefixes.sums, following.prefixes.sums, _UP):
            moved = int(other[taken]) * int(up.upto(kept + 1)[kept])
            whole = whole << 31 | (int(own[kept]) + moved) % up.prime
        mixed = np.concatenate([self.mixed[:kept], seam.mixed, following.mixed[WIDTH - 1 : max(taken, WIDTH - 1)]])
        return _written(kept + taken, whole, mixed)


def _written(n: int, whole: int, mixed: np.ndarray) -> str:
    lowest = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(lowest, (mixed & np.uint64(BINS - 1)).astype(np.int64), mixed >> np.uint64(6))
    # of the lowest hash the low bits: the high ones are small in every long text
    bins = [EMPTY if v == np.iinfo(np.uint64).max else f"{v & 0xFFFF:04x}" for v in lowest.tolist()]
    return f"{n:08x}{whole:016x}{''.join(bins)}"


def fingerprint(text: str) -> str:
    """Length, whole hash and sketch as text; an empty text has an empty sketch."""
    return Marked(code_points(text)).fingerprint()


def likeness(a: Column, b: Column) -> Column:
    """Share of the sketch classes used by either text in which two fingerprints agree; 1 for equal fingerprints.

    Two empty texts are alike (1), an empty and another text are not (0).
    """
    head = F.least(F.length(a), F.length(b)) - BINS * DIGITS

    def parts(x: Column) -> Column:
        return F.regexp_extract_all(F.substring(x, -BINS * DIGITS, BINS * DIGITS), F.lit("." * DIGITS), F.lit(0))

    # 0 for a class that neither uses
    marks = F.zip_with(parts(a), parts(b), lambda x, y: F.when(x != y, 1).when(x == EMPTY, 0).otherwise(2))
    counts = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("used"), F.lit(0).alias("same")),
        lambda s, m: F.struct((s.used + F.least(m, F.lit(1))).alias("used"), (s.same + F.greatest(m - 1, F.lit(0))).alias("same")),
        lambda s: F.coalesce(F.try_divide(s.same, s.used), F.lit(0.0)),
    )
    return F.when((a == b) | (head < 0), (a == b).cast("double")).otherwise(counts)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of the following one, or all it has."""
    replaced = len(text) // 2
    return text[: len(text) - replaced] + following[:replaced]


def with_following(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint; edited (the edited text), edited_fingerprint; next_fingerprint.

    The next document is the one with the next lower doc_id, after the last the first. The rows are dealt by ranges of
    doc_id and sorted inside them; each range also gets the one document that follows it, so no task holds more than two
    texts at a time and nothing is sorted as a whole. Missing texts count as empty. Missing identifiers come last, rows with
    one identifier are ordered by their texts, descending. A single document follows itself; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    parts = partitions(spark)
    placed = rows.withColumn("range", range_bucket("doc_id", id_bounds(rows, parts)))
    # one row for each range
    heads = sorted(placed.groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect())
    taker = {head.range: heads[(k + 1) % len(heads)].range for k, head in enumerate(heads)}
    wanted = spark.createDataFrame([(h.doc_id, taker[h.range]) for h in heads], "head_id long, taker int")
    following = (
        rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("head_id")))
        .groupBy("doc_id", "taker")
        .agg(F.max("text").alias("text"))
        .select(F.col("taker").alias("range"), "doc_id", "text", F.lit(True).alias("after"))
    )
    both = placed.select("range", "doc_id", "text", F.lit(False).alias("after")).unionByName(following)
    dealt = evenly_dealt(both, "range", parts).sortWithinPartitions(
        "range", "after", F.col("doc_id").desc_nulls_last(), F.col("text").desc()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in bounded(batches, 2):
            out = []
            for place, doc_id, text, after in zip(*(batch.column(i).to_pylist() for i in range(4))):
                marked = Marked(code_points(text))
                mark = marked.fingerprint()
                if last is not None and last[0] == place:
                    changed = last[3].edited_fingerprint(marked)
                    out.append((last[1], len(last[2]), last[4], edited(last[2], text), changed, mark))
                last = None if after else (place, doc_id, text, marked, mark)
            if out:
                kinds = (pa.int64(), pa.int64(), *[pa.string()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], NAMES)

    return dealt.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(NAMES, ("long", "long", *["string"] * 4))))


NAMES = ["doc_id", "n_chars", "fingerprint", "edited", "edited_fingerprint", "next_fingerprint"]
