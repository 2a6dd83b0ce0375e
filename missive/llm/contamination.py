"""Benchmark items inside documents: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters, digits and underscores in lower case; a shingle is five of them in a row, or all words of an item
that has fewer. A window is a run of as many words as an item has, or the whole document if that is shorter. Only windows
that contain a shingle of an item of their size can be similar to one, so the others are passed over. The rest get a SimHash
of their shingles, repeats included. The 64 bits are cut into BLOCKS blocks; fingerprints that differ in at most RADIUS bits
differ in at most one bit of some block, so every item is entered under all values within one bit of each of its blocks and
none within the radius is missed. Candidates within the radius are compared exactly: sum of the lesser over sum of the greater
shingle counts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded, texts

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS = 12
RADIUS = 2 * BLOCKS - 1
# items held by a task at a time; more are searched for in further passes
ITEMS_AT_ONCE = 4096
# windows fingerprinted at a time
WINDOWS_AT_ONCE = 8192
WORD = re.compile(r"\w+")
EDGES = [64 * k // BLOCKS for k in range(BLOCKS + 1)]
RESULT = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    width = min(SHINGLE, len(words))
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)] if words else []


def similarity(a: list[str], b: list[str], width: int) -> float:
    """Weighted similarity of the shingles of `width` words of two runs of words."""
    x, y = (Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) for w in (a, b))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 0.0


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _window_prints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of `size` shingles."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[size:] - sums[:-size]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


class _Sized:
    """The items of one number of words, under the values of their blocks."""

    def __init__(self, size: int) -> None:
        self.size, self.width = size, min(SHINGLE, size)
        self.items: list[int | None] = []
        self.words: list[list[str]] = []

    def seal(self) -> None:
        self.prints = np.array(
            [_window_prints(_shingle_hashes(_word_hashes(w), self.width), self.size - self.width + 1)[0] for w in self.words],
            dtype=np.uint64,
        )
        self.tables = []
        for low, high in zip(EDGES, EDGES[1:]):
            table = defaultdict(list)
            mask = np.uint64((1 << (high - low)) - 1)
            for k, value in enumerate(((self.prints >> np.uint64(low)) & mask).tolist()):
                for near in (value, *(value ^ (1 << b) for b in range(high - low))):
                    table[near].append(k)
            self.tables.append((low, mask, dict(table)))

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (window, item) within the radius."""
        pairs = set()
        for low, mask, table in self.tables:
            values = (prints >> np.uint64(low)) & mask
            for value in np.unique(values).tolist():
                for item in table.get(value, ()):
                    at = np.flatnonzero(values == value)
                    near = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
                    pairs.update((int(w), item) for w in at[near])
        return iter(sorted(pairs))


class Index:
    """What a task needs of at most ITEMS_AT_ONCE items."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.sizes: dict[int, _Sized] = {}
        self.known: dict[str, int] = {}
        # by shingle width: sizes of the items that have the shingle
        self.homes: dict[int, dict[tuple[int, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            sized = self.sizes.setdefault(len(words), _Sized(len(words)))
            sized.items.append(item_id)
            sized.words.append(words)
            numbers = [self.known.setdefault(w, len(self.known) + 1) for w in words]
            for k in range(len(words) - sized.width + 1):
                self.homes[sized.width][tuple(numbers[k : k + sized.width])].add(len(words))
        for sized in self.sizes.values():
            sized.seal()

    def anchors(self, words: list[str]) -> dict[int, list[int]]:
        """By size: first words of the shingles that some item of this size has."""
        numbers = np.fromiter(map(self.known.get, words, _ZEROS), dtype=np.int64, count=len(words))
        found: dict[int, list[int]] = defaultdict(list)
        here = numbers > 0
        if not here.any():
            return found
        for width, homes in self.homes.items():
            n = len(words) - width + 1
            if n <= 0:
                continue
            full = here[:n].copy()
            for k in range(1, width):
                full &= here[k : k + n]
            for at in np.flatnonzero(full).tolist():
                for size in homes.get(tuple(numbers[at : at + width].tolist()), ()):
                    found[size].append(at)
        return found

    def search(self, text: str) -> list[tuple[int | None, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item, the first of equals."""
        words = words_of(text)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        anchors = self.anchors(words)
        if not anchors:
            return []
        hashes = _word_hashes(words)
        for size, places in anchors.items():
            sized = self.sizes[size]
            span = min(size, len(words))
            last = len(words) - span
            # windows that contain an anchor, as runs of first words
            low = np.clip(np.array(places) + sized.width - span, 0, last)
            high = np.clip(np.array(places), 0, last)
            runs: list[list[int]] = []
            for a, b in zip(low.tolist(), high.tolist()):
                if runs and a <= runs[-1][1] + 1:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            for a, b in runs:
                for begin in range(a, b + 1, WINDOWS_AT_ONCE):
                    end = min(begin + WINDOWS_AT_ONCE, b + 1)
                    part = _shingle_hashes(hashes[begin : end - 1 + span], sized.width)
                    for w, k in sized.candidates(_window_prints(part, span - sized.width + 1)):
                        score = similarity(words[begin + w : begin + w + span], sized.words[k], sized.width)
                        if score >= SIMILARITY and score > best.get((size, k), (0.0,))[0]:
                            best[size, k] = (score, begin + w, span)
        return [(self.sizes[size].items[k], *found) for (size, k), found in sorted(best.items())]


class _Zeros:
    def __iter__(self):
        return self

    def __next__(self) -> int:
        return 0


_ZEROS = _Zeros()


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: for every item the best window of each document that reaches 0.8.

    The items are taken in lots of at most about ITEMS_AT_ONCE, all documents pass by each lot. Missing texts count as empty
    and, like items without words, match nothing; missing identifiers are carried along; repeated documents or items give
    repeated rows; of equally similar windows the first counts; columns besides the named are left out. A very long document
    is searched in runs of windows. Empty tables give no rows.
    """
    rows = texts(docs, id_col, text_col)
    found = docs.sparkSession.createDataFrame([], RESULT)
    for pairs in _lots(texts(benchmark, item_col, item_text_col)):
        found = found.unionByName(rows.mapInArrow(_search(pairs), RESULT))
    return found


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of `docs`, all their columns, in which `leaks` finds no item."""
    place = docs.columns.index(text_col)

    def clean(items: list[tuple[int | None, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items)
            for batch in bounded(batches, place):
                yield batch.filter(pa.array([not index.search(t or "") for t in batch.column(place).to_pylist()], pa.bool_()))

        return run

    for pairs in _lots(texts(benchmark, item_col, item_text_col)):
        docs = docs.mapInArrow(clean(pairs), docs.schema)
    return docs


def _lots(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items in lots of about ITEMS_AT_ONCE, dealt by hash."""
    lots = -(-items.count() // ITEMS_AT_ONCE)
    for lot in range(lots):
        own = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(lots)) == lot).collect()
        yield sorted(((r.doc_id, r.text) for r in own), key=lambda p: (p[0] is None, p[0] or 0, p[1]))


def _search(items: list[tuple[int | None, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(items)
        for batch in bounded(batches, 1):
            lines = [
                (doc_id, *found)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for found in index.search(text)
            ]
            if lines:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), kinds)], names)

    return run
