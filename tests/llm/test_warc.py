"""Archives written and read back, cut records in any order, damaged records, foreign files."""

import gzip
import hashlib
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from missive.llm import warc
from missive.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected(rows):
    out = []
    digests = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= warc.LEAST_REPEAT and page is not None:
            digests.setdefault(payload, []).append(page)
    for page, _, html in rows:
        payload = (html or "").encode()
        first = min(digests.get(payload, [page]), key=lambda x: (x is None, x))
        again = page is not None and first is not None and page > first
        kind, to = ("revisit", first) if again else ("response", None)
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), kind, to))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


@pytest.mark.parametrize("segment, chunk", [(4096, 2048), (50, 7), (1, 1000)])
def test_round_trip(spark, tmp_path, segment, chunk):
    rng = random.Random(segment)
    long = "é" * 60
    texts = [None, "", "x", long[:49], "a" * 99, "a" * 100, long, long, "0\r\n\r\n", "\r\n" * 80, "WARC/1.1\r\n\r\n" * 20]
    rows = [(k, f"http://h/{k} a\r\nb", t) for k, t in enumerate(texts * 2)]
    rows += [(100 + k, None, "hot " * 40) for k in range(60)] + [(3, "", "hot " * 40), (3, "", "hot " * 40)]
    rows += [(None, "u", "hot " * 40), (None, None, None), (7, "u", long), (7, "u", "y" * 300)]
    rows += [(200 + k, "u", "".join(rng.choices("ab<>\n€", k=rng.choice([90, 110, 5000])))) for k in range(15)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, digest string, payload string")
    folder = f"file://{tmp_path}/out"
    warc.write(pages.repartition(4), folder, segment=segment, chunk=chunk, file_bytes=2000)
    back = warc.read_back(spark, folder)
    assert back.where("error IS NOT NULL").count() == 0
    assert got(back) == expected(rows)


def test_payloads_are_the_texts(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    folder = f"file://{tmp_path}/out"
    warc.write(pages, folder, segment=700, chunk=333)
    manifest = spark.read.parquet(f"{folder}/manifest")
    found = warc.payloads(warc.read(manifest))
    back = found.select(warc.page_of(F.col("record_id")).alias("page_id"), F.col("payload").cast("string").alias("html"))
    assert sorted(back.collect()) == sorted(pages.select("page_id", "html").collect())


def test_no_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    warc.write(pages, f"file://{tmp_path}/out")
    assert warc.read_back(spark, f"file://{tmp_path}/out").collect() == []


def record(kind, name, block, *more):
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), *more, ("content-length", len(block))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def part(origin, number, block, total=None):
    more = [("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", number)]
    return record("continuation", f"{origin}-{number}", block, *more, *([("WARC-Segment-Total-Length", total)] if total else []))


def test_foreign_files(spark, tmp_path):
    http = ("Content-Type", "application/http; msgtype=response")
    first = ("WARC-Segment-Number", 1)
    plain = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody"
    odd = b"HTTP/1.1 200 OK\r\ntransfer-encoding:\r\n  Chunked\r\n\r\n4;ext=1\r\nab\r\n\r\n0003\r\ncde\r\n0\r\nTrailer: z\r\n\r\n"
    files = {
        "a.warc": record("warcinfo", "i", b"software: x")
        + part("cut", 3, odd[60:], len(odd))
        + record("resource", "r", b"HTTP is not looked for here", ("Content-Type", "text/plain"))
        + record("response", "lost", plain[:9], http, first),
        "b.warc.gz": b"".join(
            gzip.compress(x)
            for x in [
                record("response", "plain", plain, http),
                record("response", "cut", odd[:20], http, first),
                part("gap", 3, b"z", 12),
                part("orphan", 2, b"z", 12),
                record("response", "gap", odd[:20], http, first),
            ]
        ),
        "c.warc.gz": gzip.compress(part("cut", 2, odd[20:60]) + part("lost", 2, plain[9:], 99) + record("response", "e", b"", http))
        + gzip.compress(record("response", "chunk", odd[:-20], http))
        + gzip.compress(record("response", "digest", plain, http, ("WARC-Payload-Digest", "sha256:00")))
        + gzip.compress(record("response", "half", plain, http))[:-25],
        "d.warc": b"no archive\r\n",
        "e.warc": b"",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    names = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in files] + [(None,)], "path string")
    records = warc.read(names)
    damaged = {r.path[-6:]: r.error for r in records.where("error IS NOT NULL").collect()}
    assert set(damaged) == {"arc.gz", "d.warc"}
    back = {r.record_id: (bytes(r.payload) if r.payload is not None else None, r.error) for r in warc.payloads(records).collect()}
    assert back == {
        "plain": (b"body", None),
        "cut": (b"ab\r\ncde", None),
        "r": (b"HTTP is not looked for here", None),
        "lost": (None, "total length differs"),
        "gap": (None, "part missing"),
        "orphan": (None, "part missing"),
        "e": (None, "message without end of headers"),
        "chunk": (None, "chunk cut off"),
        "digest": (b"body", "digest differs"),
    }


def test_query_over_the_table(spark):
    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    assert got(QUERIES["op11_warc_segments"](spark, SF)) == expected(rows)
