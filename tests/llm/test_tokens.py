"""SentencePiece encoding and token files against the libraries, exactly."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from missive.llm import pieces, queries, token_files
from missive.llm.common import shared_folder

LETTERS = list("aAbBßẞŒœİıΣςKÅ \n\t\r\x0b\x1c\x85  é'sSdDre.,!?0129_-<|>▁\0中🙂́ﬁ") + ["<|endoftext|>", "</s>", "<0x0A>", "'LL", "don't", " word."]


def strings(n, seed=4):
    rng = random.Random(seed)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return ["", " ", "\n", "a" * 300, "abcabc" * 500, "=-" * 800, "x " * 20_000, *made]


def test_encode_and_decode_equal_library():
    path = queries.PIECES
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    lot = strings(3000)
    own = pieces.Pieces(path)
    ids, ends = own.encode(lot)
    want = library.encode(lot)
    assert [ids[b:e].tolist() for b, e in zip([0, *ends[:-1]], ends)] == want
    assert own.decode(ids, ends) == [library.decode(w) for w in want]
    rng = random.Random(1)
    odd = [[rng.randrange(own.size) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    odd += [[rng.randrange(3, 259) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    assert own.decode(np.array(sum(odd, [])), np.cumsum([len(o) for o in odd])) == [library.decode(o) for o in odd]
    with pytest.raises(ValueError):
        own.decode(np.array([own.size]), np.array([1]))


def unbroken(n, letters, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(letters) for _ in range(n))


def test_long_segments_equal_library():
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    own = pieces.Pieces(queries.PIECES)
    code = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    lot = [unbroken(n, letters, n) for n in (256, 257, 300, 3000) for letters in (code, "etaoin", "aab", "中文字é🙂a", "▁ a", "=-#")]
    lot += ["thequickbrownfox" * 400, "a" * 5001, " " * 4000, "0" * 777 + " " + "ab" * 900 + "\n" + "x" * 400]
    ids, ends = own.encode(lot)
    assert [ids[b:e].tolist() for b, e in zip([0, *ends[:-1]], ends)] == library.encode(lot)


def test_a_million_signs_without_blanks():
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    text = unbroken(1_000_000, "abcdefghijklmnopqrstuvwxyz", 3)
    begun = time.monotonic()
    ids, _ = pieces.Pieces(queries.PIECES).encode([text])
    assert time.monotonic() - begun < 60
    assert ids.tolist() == library.encode(text)


def test_tables_start_anew_without_changing_results(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_SEGMENTS", 10)
    monkeypatch.setattr(token_files, "KEPT_PIECES", 10)
    own, words = pieces.Pieces(queries.PIECES), token_files.Vocabulary(queries.WORDS)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for seed in range(3):
        lot = strings(50, seed)
        assert own.encode(lot)[0].tolist() == sum(library.encode(lot), [])
        assert words.encode(lot, 1) == [np.array([*e.ids, 1], dtype="<u2").tobytes() for e in words.tokenizer.encode_batch(lot, add_special_tokens=False)]


ROWS = [(3, "some Text here", 1), (None, "lost", 1), (1, None, 2), (3, "some Text here", 1), (2, "", 3), (5, "long word. " * 9000, 4)]


def test_odd_rows_of_pieces(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids int")
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    got = pieces.decode(pieces.encode(docs, queries.PIECES), queries.PIECES).collect()
    assert sorted(map(str, pieces.round_trip(docs, queries.PIECES).collect())) == sorted(map(str, got))
    assert sorted((str(r.doc_id), r.ids, r.text) for r in got) == sorted((str(i), library.encode(t or ""), t or "") for i, t, _ in ROWS)
    assert pieces.decode(pieces.encode(docs.limit(0), queries.PIECES), queries.PIECES).count() == 0


def test_token_files(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, start int")
    folder = shared_folder(spark, "test-files")
    token_files.write(docs, folder, queries.WORDS, length=8)
    library = Tokenizer.from_file(queries.WORDS)
    want, start = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.read(spark, folder).collect()), key=lambda r: r[1]) == want
    sizes = {r.path: r.n for r in spark.read.parquet(f"{folder}/index").groupBy("path").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert sum(sizes.values()) == start
    for path, n in sizes.items():
        reader = token_files.SequenceReader(path)
        flat = reader.span(0, n)
        for k in range(-(-n // 8)):
            ids, mask = reader.sequence(k)
            assert len(ids) == len(mask) == 8 and mask.sum() == min(8, n - 8 * k)
            assert ids[mask].tolist() == flat[8 * k : 8 * k + 8].tolist()
            assert not ids.flags.owndata  # a view of the mapped file
    empty = shared_folder(spark, "test-files")
    token_files.write(docs.limit(0), empty, queries.WORDS)
    assert token_files.read(spark, empty).count() == 0


def test_whole_texts_at_once(spark):
    lot = strings(200)
    words = token_files.Vocabulary(queries.WORDS, by_piece=False)
    assert words.encode(lot, 1) == token_files.Vocabulary(queries.WORDS).encode(lot, 1)
    assert public_tokenizers.path("word_bpe_49k.json") == queries.WORDS


def test_batches_of_sequences(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 2)
    out = token_files.SequenceFile(f"{tmp_path}/x.arrow", np.dtype("<u2"), 4, 1)
    lots = [np.arange(n, dtype="<u2") for n in (3, 0, 17, 1, 8, 6)]
    places = [out.add(lot.tobytes()) for lot in lots]
    out.close()
    reader = token_files.SequenceReader(f"{tmp_path}/x.arrow")
    assert reader.file.num_record_batches > 2
    for (at, count), lot in zip(places, lots):
        assert count == len(lot) and reader.span(at, count).tolist() == lot.tolist()
    flat = np.concatenate(lots).tolist()
    for k in range(9):
        ids, mask = reader.sequence(k)
        assert ids[mask].tolist() == flat[4 * k : 4 * k + 4]
