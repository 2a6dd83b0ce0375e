"""Token ids in Arrow files of equal-length sequences, written and read in parallel.

A file holds record batches of two columns: `ids`, fixed-size lists of unsigned integers as narrow as the vocabulary allows,
and `mask`, fixed-size lists of booleans that are false on the padding of the file's last sequence. All batches but the last
have the same number of sequences, so sequence k of a memory-mapped file is found without reading others and without a
copy. Files follow one another in ascending doc_id order. Beside them lies a Parquet index: file number, path, document,
position of its first id in the file, number of ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from missive.llm.common import bounded, evenly_dealt, id_bounds, partitions, range_numbers, texts

SEQUENCE = 1024
BATCH_SEQUENCES = 256
# pieces kept by a task before it starts its table anew; bounds memory, not results
KEPT_PIECES = 500_000
WORDS_AT_ONCE = 1000
# letters up to here have one lower-case letter each, and no composition; the dotted capital I is the exception
NOT_SIMPLE = re.compile("[^\x00-\u012f\u0131-\u024f]")
# one word a line
PLAIN_WORD = re.compile("^([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,]?)$", re.MULTILINE)

INDEX = "file int, path string, doc_id long, position long, n_tokens long"


class Vocabulary:
    """The tokenizers library over the distinct pieces of texts between blanks.

    `by_piece` says that no token spans white space and that case does not matter, which holds for vocabularies whose first
    steps drop white space and lower the case. Words of letters alone are encoded many at a time and told apart by the
    tokens that end a word.
    """

    def __init__(self, path: str, by_piece: bool = True) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = by_piece
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        ends = self.tokenizer.get_vocab() if suffix else {}
        self.ends_word = np.zeros(max(ends.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for token, i in ends.items() if token.endswith(suffix)]] = bool(suffix)
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.width).tobytes() for e in found]

    def _learn_words(self, words: list[str]) -> None:
        lots = [words[k : k + WORDS_AT_ONCE] for k in range(0, len(words), WORDS_AT_ONCE)]
        for lot, line in zip(lots, self._ids([" ".join(lot) for lot in lots])):
            ids = np.frombuffer(line, dtype=self.width)
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * self.width.itemsize).tolist()
            if len(ends) == len(lot) and ends[-1:] == [len(line)]:
                self.known.update(zip(lot, (line[b:e] for b, e in zip([0, *ends], ends))))
            else:
                self.known.update(zip(lot, self._ids(lot)))

    def _learn(self, pieces: set[str]) -> None:
        known, rest = self.known, pieces
        if self.ends_word.any():
            # no piece has a line feed in it
            plain = PLAIN_WORD.findall("\n".join(pieces))
            self._learn_words(list({w for w, _ in plain}.difference(known)))
            marks = dict(zip(".,", self._ids([".", ","])))
            known.update([(w + mark, known[w] + marks[mark]) for w, mark in plain if mark])
            rest = pieces.difference(known)
        known.update(zip(rest, self._ids(list(rest))))

    def encode(self, batch: list[str], end_id: int) -> list[bytes]:
        end = np.array([end_id], dtype=self.width).tobytes()
        if not self.by_piece:
            return [ids + end for ids in self._ids(batch)]
        cut = [(t if NOT_SIMPLE.search(t) else t.lower()).replace("\n", " ").split(" ") for t in batch]
        if len(self.known) > KEPT_PIECES:
            self.known = {"": b""}
        fresh = set().union(*cut).difference(self.known)
        if fresh:
            self._learn(fresh)
        known = self.known.__getitem__
        return [b"".join(map(known, parts)) + end for parts in cut]


@lru_cache(maxsize=2)
def vocabulary(path: str, by_piece: bool) -> Vocabulary:
    # a task has one core; the library's own threads would only compete
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Vocabulary(path, by_piece)


class SequenceFile:
    """Appends ids to one file; complete only after `close`, which puts it in place under its final name."""

    def __init__(self, path: str, width: np.dtype, length: int, pad_id: int) -> None:
        self.path, self.width, self.length, self.pad_id = path, width, length, pad_id
        self.files, self.place = fs.FileSystem.from_uri(path)
        self.own = f"{self.place}.{os.getpid()}-{os.urandom(4).hex()}"
        ids = pa.list_(pa.from_numpy_dtype(width), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = self.files.open_output_stream(self.own)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[bytes] = []
        self.size = self.written = 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Position and number of the ids added."""
        at, count = self.written, len(raw) // self.width.itemsize
        self.waiting.append(raw)
        self.size += count
        self.written += count
        if self.size >= BATCH_SEQUENCES * self.length:
            self._flush(last=False)
        return at, count

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), dtype=self.width)
        per_batch = BATCH_SEQUENCES * self.length
        full = len(ids) // per_batch * per_batch
        for begin in range(0, full, per_batch):
            self._write(ids[begin : begin + per_batch], per_batch)
        rest = ids[full:]
        if last and len(rest):
            padded = np.full(-(-len(rest) // self.length) * self.length, self.pad_id, dtype=self.width)
            padded[: len(rest)] = rest
            self._write(padded, len(rest))
            rest = rest[:0]
        self.waiting, self.size = [rest.tobytes()], len(rest)

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()
        # a task that runs twice leaves the same content under the same name
        self.files.move(self.own, self.place)


class SequenceReader:
    """Random access to the ids of one file; a local file is mapped, not read."""

    def __init__(self, path: str) -> None:
        files, place = fs.FileSystem.from_uri(path)
        source = pa.memory_map(place) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(place)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch_sequences = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _batch(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            self.kept = (k, self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.kept[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence k."""
        batch = self.file.get_batch(k // self.batch_sequences)
        row = k % self.batch_sequences
        ids = batch.column("ids").flatten()[row * self.length : (row + 1) * self.length]
        mask = batch.column("mask").flatten()[row * self.length : (row + 1) * self.length]
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def span(self, position: int, count: int) -> np.ndarray:
        per_batch, parts = self.batch_sequences * self.length, []
        while count > 0:
            k, at = divmod(position, per_batch)
            part = self._batch(k)[at : at + count]
            parts.append(part)
            position += len(part)
            count -= len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=np.uint32), *parts]).astype(np.uint32)


def write(
    docs: DataFrame,
    folder: str,
    vocabulary_path: str,
    end_id: int = 1,
    by_piece: bool = True,
    length: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encodes every whole text, appends `end_id`, and writes files and index below `folder`.

    The documents are dealt by ranges of doc_id into as many files as there are shuffle partitions; a file is written in one
    pass with a bounded buffer. A missing text counts as empty and has the end id only; missing identifiers come first,
    rows with one identifier are ordered by their ids; columns besides the two are left out; no rows give an empty index.
    """
    rows = texts(docs, id_col, text_col)
    parts = partitions(docs.sparkSession)
    bounds = id_bounds(rows, parts)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(vocabulary_path, by_piece)
        for batch in bounded(batches, 1):
            found = pa.array(words.encode(batch.column(1).to_pylist(), end_id), pa.binary())
            numbers = range_numbers(batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64), bounds)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), batch.column(0), found], ["file", "doc_id", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current = None, None
        width = vocabulary(vocabulary_path, by_piece).width
        for batch in bounded(batches, 2):
            lines = []
            for number, doc_id, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number != current:
                    if out is not None:
                        out.close()
                    current = number
                    out = SequenceFile(f"{folder}/ids-{number:05d}.arrow", width, length, end_id)
                lines.append((number, out.path, doc_id, *out.add(raw)))
            if lines:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*lines), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                    ["file", "path", "doc_id", "position", "n_tokens"],
                )
        if out is not None:
            out.close()

    encoded = rows.mapInArrow(tokenize, "file int, doc_id long, ids binary")
    ordered = evenly_dealt(encoded, "file", parts).sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "ids")
    # the index is complete only when every file is in its place
    ordered.mapInArrow(store, INDEX).write.mode("overwrite").parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all files), n_tokens, ids_crc32, read back from the files."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    # one row for each file
    sizes = sorted(index.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for number, count in sizes:
        before[number] = total
        total += count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = None, None
        for batch in batches:
            lines = []
            for number, path, doc_id, position, count in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if path != current:
                    current, reader = path, SequenceReader(path)
                ids = reader.span(position, count).astype("<u4")
                lines.append((doc_id, before[number] + position, count, zlib.crc32(ids.tobytes())))
            if lines:
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*lines)], names)

    return index.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
