"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch of texts is cut where no merge can cross (before each run of spaces, around line feeds). Each distinct segment of a
task is encoded once: all segments lie in one flat symbol array, and a round finds the lowest pair rank of every segment,
merges its leftmost pairs of that rank at once, and compacts the array; segments without a pair leave. Documents are then
put together from the segments by array indexing.

A segment of thousands of signs has thousands of rounds. Long segments therefore keep the positions of their pairs by rank, and
a round takes up only the positions of the lowest rank and their neighbours, so the work grows with the merges.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded, texts

SPACE = "▁"
# segments kept by a task before it starts its table anew; bounds memory, not results
KEPT_SEGMENTS = 300_000
# segments with more signs are merged by rank
LONG = 256
NO_PAIR = np.iinfo(np.int64).max

codecs.register_error("one_mark_per_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pieces:
    """A BPE model with byte fallback, as arrays."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)])
        normal = {names[i]: i for i in range(size) if not special[i]}
        scores = np.array([model.get_score(i) for i in range(size)])
        ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int64)

        # characters that only occur inside longer pieces get symbols of their own behind the vocabulary
        symbols = dict(normal)
        for name in normal:
            for letter in name:
                symbols.setdefault(letter, len(symbols) + size)
        self.width = max(symbols.values()) + 1
        self.of_letter = -1 - np.arange(0x110000, dtype=np.int64)  # unknown letters: below zero
        for name, i in symbols.items():
            if len(name) == 1:
                self.of_letter[ord(name)] = i

        pairs = sorted(
            (symbols[name[:k]] * self.width + symbols[name[k:]], i)
            for name, i in normal.items()
            for k in range(1, len(name))
            if name[:k] in symbols and name[k:] in symbols
        )
        self.pair_keys = np.array([p[0] for p in pairs], dtype=np.int64)
        self.pair_piece = np.array([p[1] for p in pairs], dtype=np.int64)
        self.pair_rank = ranks[self.pair_piece]
        # where no pair with the new piece ranks before it, equal pairs of a segment can be merged in one round
        first = np.full(self.width, NO_PAIR)
        np.minimum.at(first, self.pair_keys // self.width, self.pair_rank)
        np.minimum.at(first, self.pair_keys % self.width, self.pair_rank)
        self.at_once = first[:size] > ranks

        long_names = [n for n in normal if len(n) > 1]
        self.cuts_at_spaces = not any(SPACE in n.lstrip(SPACE) for n in long_names)
        self.cuts_at_lines = not any("\n" in n for n in long_names)

        self.byte_ids = np.zeros(256, dtype=np.int64)
        surface: list[bytes] = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                surface.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i):
                surface.append(b"")
            elif model.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(name.replace(SPACE, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), dtype=np.uint8)
        self.surface_len = np.array([len(s) for s in surface], dtype=np.int64)
        self.surface_at = np.concatenate([[0], np.cumsum(self.surface_len)])
        self.begins_with_space = np.array([not special[i] and n.startswith(SPACE) for i, n in enumerate(names)])
        self.silent = np.array([model.is_control(i) for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat = np.zeros(0, dtype=np.int32)
        self.ends = np.zeros(1, dtype=np.int64)

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.cuts_at_spaces:
            return [SPACE + text.replace(" ", SPACE)]
        if not self.cuts_at_lines or "  " in text or SPACE in text or "\0" in text or text[0] == " ":
            line = "\n" if self.cuts_at_lines else ""
            whole = SPACE + text.replace(" ", SPACE)
            return re.findall(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + ("|\n" if line else ""), whole)
        return (SPACE + text.replace(" ", "\0" + SPACE).replace("\n", "\0\n\0")).split("\0")

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and the number of ids of each word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbol = self.of_letter[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        is_long = np.repeat(lengths > LONG, lengths)
        if is_long.any():
            found = self._merged_by_rank(symbol[is_long], word[is_long])
            done_symbol.append(found[0])
            done_word.append(found[1])
            symbol, word = symbol[~is_long], word[~is_long]
        while len(symbol):
            rank = np.full(len(symbol), NO_PAIR)
            piece = np.zeros(len(symbol), dtype=np.int64)
            pair = np.flatnonzero(word[:-1] == word[1:])
            rank[pair], piece[pair] = self._pairs(symbol[pair], symbol[pair + 1])

            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            lowest = np.minimum.reduceat(rank, starts)
            ended = np.repeat(lowest == NO_PAIR, sizes)
            if ended.any():
                done_symbol.append(symbol[ended])
                done_word.append(word[ended])
            chosen = np.flatnonzero((rank == np.repeat(lowest, sizes)) & ~ended)
            if not len(chosen):
                break
            # of neighbouring pairs every second one, from the left
            run = np.concatenate([[True], (chosen[1:] != chosen[:-1] + 1) | (word[chosen[1:]] != word[chosen[:-1]])])
            place = np.arange(len(chosen))
            place -= np.maximum.accumulate(np.where(run, place, 0))
            leading = np.concatenate([[True], word[chosen[1:]] != word[chosen[:-1]]])
            chosen = chosen[(place % 2 == 0) & (leading | self.at_once[piece[chosen]])]
            symbol[chosen] = piece[chosen]
            stays = ~ended
            stays[chosen + 1] = False
            symbol, word = symbol[stays], word[stays]

        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        symbol, word = symbol[order], word[order]
        foreign = (symbol < 0) | (symbol >= self.size)
        if foreign.any():
            symbol, word = self._as_bytes(symbol, word, foreign)
        return symbol.astype(np.int32), np.bincount(word, minlength=len(words))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of neighbouring symbols; NO_PAIR where they make no piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.width + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], NO_PAIR), np.where(hit, self.pair_piece[at], 0)

    def _merged_by_rank(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when no pair remains, and their words; each round takes the positions of the lowest rank only."""
        n = len(symbol)
        # position n stands for the end of every word; nothing pairs with it
        symbol = np.append(symbol, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        edge = np.flatnonzero(word[1:] != word[:-1])
        after[edge], before[edge + 1] = n, -1
        rank, piece = np.full(n + 1, NO_PAIR), np.zeros(n + 1, dtype=np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            rank[at], piece[at] = self._pairs(symbol[at], symbol[after[at]])
            at = at[rank[at] != NO_PAIR]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            values = rank[at]
            cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                value = int(values[begin])
                if value not in waiting:
                    waiting[value] = []
                    heapq.heappush(ranks, value)
                waiting[value].append(at[begin:end])

        look(np.arange(n))
        while ranks:
            lowest = heapq.heappop(ranks)
            chosen = np.concatenate(waiting.pop(lowest))
            chosen = np.unique(chosen[rank[chosen] == lowest])
            if not len(chosen):
                continue
            # of neighbouring pairs every second one, from the left
            run = np.concatenate([[True], after[chosen[:-1]] != chosen[1:]])
            place = np.arange(len(chosen))
            place -= np.maximum.accumulate(np.where(run, place, 0))
            leading = np.concatenate([[True], word[chosen[1:]] != word[chosen[:-1]]])
            taken = (place % 2 == 0) & (leading | self.at_once[piece[chosen]])
            left, chosen = chosen[~taken], chosen[taken]
            gone = after[chosen]
            symbol[chosen] = piece[chosen]
            rank[gone], symbol[gone] = NO_PAIR, -1
            word[gone[gone < n]] = -1
            after[chosen] = after[gone]
            before[after[chosen]] = chosen
            touched = np.concatenate([chosen, before[chosen], left[word[left] >= 0]])
            look(np.unique(touched[touched >= 0]))
        stays = word >= 0
        return symbol[:n][stays], word[stays]

    def _as_bytes(self, symbol: np.ndarray, word: np.ndarray, foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces symbols outside the vocabulary by the ids of their UTF-8 bytes."""
        behind = {int(self.of_letter[c]): c for c in np.flatnonzero(self.of_letter >= self.size)}
        spelt = [chr(-1 - s if s < 0 else behind[s]).encode() for s in symbol[foreign].tolist()]
        times = np.ones(len(symbol), dtype=np.int64)
        times[foreign] = [len(b) for b in spelt]
        out = np.repeat(symbol, times)
        out[np.repeat(foreign, times)] = self.byte_ids[np.frombuffer(b"".join(spelt), dtype=np.uint8)]
        return out, np.repeat(word, times)

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends."""
        cut = [self.segments(t) for t in batch]
        if len(self.known) > KEPT_SEGMENTS:
            self._forget()
        new = list(dict.fromkeys(s for parts in cut for s in parts if s not in self.known))
        if new:
            flat, counts = self.merged(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.flat = np.concatenate([self.flat, flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        known = self.known
        which = np.array([known[s] for parts in cut for s in parts], dtype=np.int64)
        begins = np.concatenate([[0], self.ends[:-1]])[which]
        sizes = self.ends[which] - begins
        ids = self.flat[_spread(begins, sizes)]
        totals = np.concatenate([[0], np.cumsum(sizes)])
        return ids, totals[np.cumsum([len(parts) for parts in cut], dtype=np.int64)]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        sizes = self.surface_len[ids]
        raw = self.surface[_spread(self.surface_at[ids], sizes)].tobytes()
        at = np.concatenate([[0], np.cumsum(sizes)])
        out, begin = [], 0
        for end in ends.tolist():
            first = begin
            while first < end and self.silent[ids[first]]:
                first += 1
            # the space put before the text on encoding
            skip = int(first < end and self.begins_with_space[ids[first]])
            out.append(raw[at[begin] + skip : at[end]].decode("utf-8", "one_mark_per_byte"))
            begin = end
        return out


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of consecutive slices, given where they begin and how long they are."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text, without begin and end ids.

    A missing text counts as empty; an empty text has no ids. Repeated rows stay repeated, missing identifiers stay
    missing, columns besides the two are left out. A very long text is one row, as its ids are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in bounded(batches, 1):
            ids, ends = model.encode(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text decoded from them. Missing ids count as none; an id outside the vocabulary is an error."""
    rows = encoded.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in bounded(batches, 1):
            lists = batch.column(1)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            found = model.decode(lists.flatten().to_numpy(zero_copy_only=False), ends[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(found, pa.string())], ["doc_id", "ids", "text"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, and the text decoded from them: `encode` and `decode` in one pass, with the same rows.

    A task keeps one model and one batch. Missing and empty texts have no ids and decode to an empty text; repeated rows and
    missing identifiers stay, columns besides the two are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in bounded(batches, 1):
            ids, ends = model.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            found = pa.array(model.decode(ids, ends), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, found], ["doc_id", "ids", "text"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, text string")
