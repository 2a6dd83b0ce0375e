"""Maximal periodic runs of words by string synchronising sets, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least `least` words and `times`
periods that neither neighbour extends. Runs are looked for from short periods to long ones. Periods below `SMALL` are the highly
periodic regions, found by comparing each word with the one q further. At scale t = 4, 8, 16, ... the synchronising set holds
the places whose window of t words has the smallest hash of the next t windows, or the window t further has. Whether a place is
in the set depends on the 2t words behind it alone, so the places of a run recur with its period: two places with the same 2t
words at a distance of 3t - 2 to 6t - 3 propose that distance as a period. Windows inside a known run with a period of at most
t / 3 do not count as smallest; so no two places with equal contexts lie closer than t / 3, and their pairs are at most 18 a
place. Every proposal is compared word by word, and a run of three periods or more always holds a proposing pair in each of its
periods, so nothing is missed and nothing false is kept.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded, texts

LEAST = 6
TIMES = 4
# periods below this are found directly; the first scale's periods begin here
SMALL = 10
# distinct words kept by a task before it starts its table anew; bounds memory, not results
KEPT_WORDS = 500_000

RUNS = "array<struct<start:long,length:long,period:long>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values: block minima from the left and from the right meet."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch of true entries."""
    edge = np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _proposals(hashes: np.ndarray, context: np.ndarray, periodic: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the synchronising set of scale t, with the distances to others that have the same 2t words behind them."""
    none = np.iinfo(np.uint64).max
    own = _mixed(hashes)
    own[periodic] = none
    count = len(context)
    least = _window_least(own[: count + t], t + 1)
    places = np.flatnonzero((least != none) & ((least == own[:count]) | (least == own[t : t + count])))
    behind = context[places]
    order = np.argsort(behind, kind="stable")
    places, behind = places[order], behind[order]
    at, distance = [], []
    for lag in itertools.count(1):
        apart = places[lag:] - places[:-lag]
        near = (behind[lag:] == behind[:-lag]) & (apart < 6 * t - 2)
        if not near.any():
            break
        near &= apart >= 3 * t - 2
        at.append(places[:-lag][near])
        distance.append(apart[near])
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (at, distance))


def _compared(words: np.ndarray, at: np.ndarray, period: np.ndarray, t: int) -> np.ndarray:
    """Begin, length and period of the runs of three periods or more around proposals, each word compared."""
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    begin = np.maximum(at - period - t, 0)
    end = np.minimum(at + 2 * t + period, len(words) - period)
    # places around proposals of one period are joined where they touch; `end` ascends with `at`
    fresh = np.concatenate([[True], (period[1:] != period[:-1]) | (begin[1:] > end[:-1])])
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    begin, size, period = begin[first], end[last] - begin[first], period[first]
    offset = np.concatenate([[0], np.cumsum(size)])
    # one false entry behind each part keeps the parts apart
    place = np.arange(offset[-1]) + np.repeat(begin - offset[:-1], size)
    equal = np.zeros(offset[-1] + len(size), dtype=bool)
    slot = np.arange(offset[-1]) + np.repeat(np.arange(len(size)), size)
    equal[slot] = words[place] == words[place + np.repeat(period, size)]
    low, high = _stretches(equal)
    part = np.searchsorted(offset[:-1] + np.arange(len(size)), low, side="right") - 1
    found = np.stack([begin[part] + low - (offset[part] + part), high - low + period[part], period[part]])
    return found[:, found[1] >= 3 * found[2]]


def runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Begin, length and smallest period of all runs of three periods or more, by begin and period.

    `words` holds numbered words of several texts, longest text first, each followed by a number of its own; `ends` are the
    ends of the texts, their own numbers included.
    """
    found = []
    for q in range(1, SMALL):
        low, high = _stretches(words[:-q] == words[q:])
        long = high - low >= 2 * q
        found.append(np.stack([low[long], high[long] - low[long] + q, np.full(int(long.sum()), q)]))
    sizes = np.diff(ends, prepend=0) - 1
    hashes = _mixed(words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    width, t = 1, 4
    while True:
        # only texts that can hold three periods of this scale
        texts_left = int(np.searchsorted(-sizes, -3 * (3 * t - 2), side="right"))
        if texts_left == 0:
            break
        n = int(ends[texts_left - 1])
        words, hashes = words[:n], hashes[: n - width + 1]
        while width < t:
            hashes, width = _doubled(hashes, width), 2 * width
        context = _doubled(hashes, width)
        known = np.concatenate(found, axis=1)
        known = known[:, (3 * known[2] <= t) & (known[1] >= t) & (known[0] + known[1] <= n)]
        depth = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(depth, known[0], 1)
        np.add.at(depth, known[0] + known[1] - t + 1, -1)
        at, period = _proposals(hashes, context, np.cumsum(depth[:-1]) > 0, t)
        if len(at):
            found.append(_compared(words, at, period, t))
        hashes, width, t = context, 2 * t, 2 * t
    found = np.concatenate(found, axis=1)
    # a stretch found with several periods has the smallest of them; three periods fit in, so the others are its multiples
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    same = (np.diff(found[:2], axis=1) == 0).all(axis=0)
    found = found[:, np.concatenate([[True], ~same])[: found.shape[1]]]
    return found[:, np.lexsort((found[2], found[0]))]


def _doubled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice the width."""
    return _mixed(hashes[:-width] * np.uint64(0x9E3779B97F4A7C15) + hashes[width:]) if len(hashes) > width else hashes[:0]


def _batch_runs(lists: list[list[bytes]], number: dict[bytes, int], least: int, times: int) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs of each text and the text without repetitions."""
    order = sorted(range(len(lists)), key=lambda k: -len(lists[k]))
    parts = []
    for place, k in enumerate(order):
        parts += [np.fromiter(map(number.__getitem__, lists[k]), np.int64, len(lists[k])), np.array([-1 - place])]
    ends = np.cumsum([len(lists[k]) + 1 for k in order])
    found = runs(np.concatenate(parts), ends)
    found = found[:, (found[1] >= least) & (found[1] >= times * found[2])]
    cuts = np.searchsorted(found[0], ends).tolist()
    results: list[np.ndarray] = [found[:, :0]] * len(lists)
    joined: list[bytes] = [b""] * len(lists)
    for k, begin, low, high in zip(order, [0, *ends.tolist()], [0, *cuts], cuts):
        words = lists[k]
        if high > low:
            own = found[:, low:high].copy()
            own[0] -= begin
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(depth, own[0] + own[2], 1)
            np.add.at(depth, own[0] + own[1], -1)
            words = list(itertools.compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))
            results[k] = own
        joined[k] = b" ".join(words)
    return results, joined


def word_runs(
    docs: DataFrame, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), and the text whose words are kept once a run, joined by one blank.

    Words are separated by ASCII white space. A word goes if a run holds it behind that run's first period. `times` is at least
    three. A missing or empty text has no words, no runs and an empty text; missing or repeated identifiers keep one row each;
    other columns are left out; no rows give no rows. A task holds a batch of texts of bounded size, or one longer text.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not looked for")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        for batch in bounded(batches, 1):
            if len(number) > KEPT_WORDS:
                number = defaultdict(itertools.count().__next__)
            lists = [t.split() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found, joined = _batch_runs(lists, number, least, times)
            spans = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in np.concatenate(found, axis=1)], ["start", "length", "period"]
            )
            offsets = np.cumsum([0, *(x.shape[1] for x in found)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in lists], pa.int64()),
                    pa.ListArray.from_arrays(offsets, spans),
                    pa.array(joined, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "text"],
            )

    return texts(docs, id_col, text_col).mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, text string")


def most_repeated(spans: Column) -> Column:
    """The run with most periods, compared as exact fractions; ties go to the smallest start, then period. None: null."""

    def better(best: Column, x: Column) -> Column:
        # runs come by start and period, so the first of equal ones stays
        more = best.isNull() | (x.length * best.period > best.length * x.period)
        return F.when(more, x).otherwise(best)

    return F.reduce(spans, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
