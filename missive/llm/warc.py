"""WARC archives: written in parallel, read back by reassembling segments and decoding chunked bodies.

A page becomes a `response` record that holds an HTTP message with a chunked body. A block longer than a segment is cut: the first
part stays in the record, the others follow as `continuation` records that name the first as their origin, are numbered from 2,
and of which the last states the length of all. Pages whose payload an earlier page has (smaller identifier, `LEAST_REPEAT` bytes
at least) become `revisit` records without payload that refer to the earlier page's record. Each record is a gzip member of its
own. Files are named by partition and number, so a task that runs again replaces its own.

Reading takes the files one by one as streams. Records that are not cut need no shuffle; the parts of a cut one meet by the
identifier of their origin, are put in order by number and joined if none is missing and their lengths add up to the total.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.llm.common import bounded, cut_lineage, joined_to_classes, partitions

LEAST_REPEAT = 100
SEGMENT = 4096
CHUNK = 2048
# a file is closed once it has this many bytes
FILE_BYTES = 64 << 20
# decoded bytes that a reader hands on at once
BATCH_BYTES = 4 << 20

MANIFEST = "path string, records long, revisits long, bytes long"
RECORD = (
    "path string, type string, record_id string, url string, refers_to string, payload_digest string, origin_id string, "
    "segment int, total_length long, content_type string, block binary, error string"
)
PAYLOAD = "record_id string, url string, payload_bytes long, payload_digest string, payload binary, error string"

# names and forms fixed by the WARC 1.1 and HTTP/1.1 formats
VERSION = b"WARC/1.1"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"


def record_id(id_col: Column, digest: Column) -> Column:
    """Name of a page's record; a missing identifier is left empty."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def page_of(name: Column) -> Column:
    """The identifier in a record's name; null if it has none."""
    return F.regexp_extract(name, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")


def chunked(payload: bytes, chunk: int) -> bytes:
    parts = [payload[k : k + chunk] for k in range(0, len(payload), chunk)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The content of a chunked body; chunk extensions and trailers are passed over. ValueError if it is damaged."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without size")
        size = body[at:end].split(b";", 1)[0].strip()
        if not re.fullmatch(b"[0-9A-Fa-f]+", size):
            raise ValueError("chunk without size")
        count, at = int(size, 16), end + 2
        if count == 0:
            return b"".join(parts)
        if body[at + count : at + count + 2] != b"\r\n":
            raise ValueError("chunk cut off")
        parts.append(body[at : at + count])
        at += count + 2


def payload_of(block: bytes, content_type: str | None) -> bytes:
    """The body of an HTTP message, of any other block the block itself."""
    if not (content_type or "").lower().startswith("application/http"):
        return block
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank:
        raise ValueError("message without end of headers")
    coding = [v for k, v in fields(head.split(b"\r\n")[1:]) if k == "transfer-encoding"]
    return dechunked(body) if any("chunked" in v.lower() for v in coding) else body


def fields(lines: Iterable[bytes]) -> list[tuple[str, str]]:
    """Names in lower case and values of header lines; a line that begins with a blank continues the one before."""
    found: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {text.strip()}")
        else:
            name, _, value = text.partition(":")
            found.append((name.strip().lower(), value.strip()))
    return found


class Archive:
    """One file being written; in place under its name once closed."""

    def __init__(self, path: str, date: str, segment: int, chunk: int) -> None:
        self.path, self.date, self.segment, self.chunk = path, date, segment, chunk
        self.files, self.place = fs.FileSystem.from_uri(path)
        self.own = f"{self.place}.{TaskContext.get().taskAttemptId()}"
        self.sink = self.files.open_output_stream(self.own)
        self.records = self.revisits = self.size = 0

    def _write(self, head: list[tuple[str, object]], block: bytes) -> None:
        head = [*head, ("WARC-Date", self.date), ("Content-Length", len(block))]
        lines = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n"
        raw = gzip.compress(lines + block + b"\r\n\r\n", mtime=0)
        self.sink.write(raw)
        self.size += len(raw)
        self.records += 1

    def response(self, name: str, url: str, digest: str, payload: bytes) -> None:
        block = HTTP_HEAD + chunked(payload, self.chunk)
        head = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", url), ("Content-Type", HTTP_TYPE)]
        head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
        parts = [block[k : k + self.segment] for k in range(0, len(block), self.segment)]
        self._write(head if len(parts) == 1 else [*head, ("WARC-Segment-Number", 1)], parts[0])
        for number, part in enumerate(parts[1:], 2):
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{number}>"), ("WARC-Target-URI", url)]
            more += [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number)]
            self._write(more if number < len(parts) else [*more, ("WARC-Segment-Total-Length", len(block))], part)

    def revisit(self, name: str, url: str, digest: str, refers_to: str) -> None:
        head = [("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Target-URI", url), ("Content-Type", HTTP_TYPE)]
        head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Refers-To", refers_to), ("WARC-Profile", REVISIT_PROFILE)]
        self._write(head, HTTP_HEAD)
        self.revisits += 1

    def close(self) -> tuple[str, int, int, int]:
        self.sink.close()
        self.files.move(self.own, self.place)
        return self.path, self.records, self.revisits, self.size


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    segment: int = SEGMENT,
    chunk: int = CHUNK,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Writes archives below `folder` and a Parquet table of them at `folder`/manifest.

    The payload is the text in UTF-8; a missing one is empty, a missing URL too, and control signs and blanks of a URL are
    percent-escaped. Rows without identifier are always responses; so are all rows that repeat identifier and payload of the
    first. Other columns are left out, and no rows give an empty manifest. Digests are taken in one pass over the payloads, and
    which page comes first is settled on digests alone; payloads move only where the list of revisits is too long to broadcast.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.where((F.length("payload") >= LEAST_REPEAT) & F.col("page").isNotNull())
    keys = cut_lineage(long.select("page", "url", "digest"))
    classes = keys.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    repeats = cut_lineage(joined_to_classes(keys, classes.drop("copies"), "digest").where("page > first"))
    name = record_id(F.col("page"), F.col("digest"))
    originals = rows.join(repeats.select("page", "digest").distinct(), ["page", "digest"], "left_anti").select(
        name.alias("name"), "url", "digest", F.lit(None).cast("string").alias("refers_to"), "payload"
    )
    revisits = repeats.select(
        name.alias("name"),
        "url",
        "digest",
        record_id(F.col("first"), F.col("digest")).alias("refers_to"),
        F.lit(None).cast("binary").alias("payload"),
    )
    # one instant for all files, also of tasks that run again
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, out = TaskContext.get().partitionId(), [], None
        for batch in bounded(batches, 4):
            for name, url, digest, refers_to, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = Archive(f"{folder}/pages-{part:06d}-{len(done):04d}.warc.gz", date, segment, chunk)
                url = re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                if refers_to is None:
                    out.response(name, url, digest, payload)
                else:
                    out.revisit(name, url, digest, refers_to)
                if out.size >= file_bytes:
                    done.append(out.close())
                    out = None
        if out is not None:
            done.append(out.close())
        if done:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*done), types)], ["path", "records", "revisits", "bytes"]
            )

    files, place = fs.FileSystem.from_uri(folder)
    files.create_dir(place)
    # the manifest is complete only when every file is in its place
    originals.unionByName(revisits).mapInArrow(store, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")


class Stream:
    """Lines and blocks of a file that may consist of gzip members, read piece by piece."""

    def __init__(self, path: str) -> None:
        files, place = fs.FileSystem.from_uri(path)
        self.source = files.open_input_stream(place, compression=None)
        self.raw = self.source.read(1 << 20)
        self.packed = self.raw[:2] == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.packed else None
        self.kept = bytearray()

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(1 << 20)
        if not self.raw:
            return False
        if not self.packed:
            self.kept += self.raw
            self.raw = b""
            return True
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        self.kept += self.member.decompress(self.raw, BATCH_BYTES)
        self.raw = self.member.unconsumed_tail or self.member.unused_data
        return True

    def line(self) -> bytes | None:
        """The next line without its end; null at the end of the file."""
        seen = 0
        while (end := self.kept.find(b"\n", seen)) < 0:
            seen = len(self.kept)
            if not self._more():
                return None
        found = bytes(self.kept[:end]).rstrip(b"\r")
        del self.kept[: end + 1]
        return found

    def block(self, count: int) -> bytes:
        while len(self.kept) < count and self._more():
            pass
        found = bytes(self.kept[:count])
        del self.kept[:count]
        return found


def records_of(path: str) -> Iterator[tuple]:
    """The records of a file in the order of RECORD; damage ends the file with a row that says so."""
    stream = Stream(path)
    try:
        while (line := stream.line()) is not None:
            if not line:
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("no record where one should begin")
            lines = []
            while line := stream.line():
                lines.append(line)
            head = dict(reversed(fields(lines)))
            count = int(head.get("content-length", "-"))
            block = stream.block(count)
            if len(block) < count:
                raise ValueError("record cut off")
            number, total = head.get("warc-segment-number"), head.get("warc-segment-total-length")
            yield (
                path,
                head.get("warc-type", "").lower(),
                head.get("warc-record-id"),
                head.get("warc-target-uri"),
                head.get("warc-refers-to"),
                head.get("warc-payload-digest"),
                head.get("warc-segment-origin-id"),
                int(number) if number else None,
                int(total) if total else None,
                head.get("content-type"),
                block,
                None,
            )
    except (ValueError, zlib.error) as damage:
        yield (path, *[None] * 10, str(damage))


def _rows(lines: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lines), schema)], schema=schema)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in text.split(", "))])


def read(files: DataFrame, path_col: str = "path") -> DataFrame:
    """One row for each record of the named archives (gzip members or plain), with its headers and whole block.

    `files` has one row for each file; a file is read as a stream by one task. A damaged file gives the records before the
    damage and a row with `error`. No files give no rows; missing names are passed over.
    """
    schema = _schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for row in records_of(path):
                    waiting.append(row)
                    size += len(row[-2] or b"") + 500
                    if size >= BATCH_BYTES:
                        yield _rows(waiting, schema)
                        waiting, size = [], 0
        if waiting:
            yield _rows(waiting, schema)

    names = files.select(F.col(path_col).alias("path")).where("path IS NOT NULL")
    spread = names.repartition(partitions(files.sparkSession), "path")
    return spread.mapInArrow(run, RECORD)


def _decoded(name: str, url: str, digest: str | None, block: bytes, content_type: str | None, content: bool) -> tuple:
    try:
        payload = payload_of(block, content_type)
    except ValueError as damage:
        return name, url, None, None, None, str(damage)
    found = hashlib.sha256(payload).hexdigest()
    wrong = digest and digest.lower().startswith("sha256:") and digest[7:].lower() != found
    return name, url, len(payload), found, payload if content else None, "digest differs" if wrong else None


def _joined(parts: list[tuple], content: bool) -> list[tuple]:
    """Payload of the parts of one record, sorted by number; an archive that is there twice gives it twice."""
    name = parts[0][0]
    by_number = {}
    for part in parts:
        if by_number.setdefault(part[1], part)[6] != part[6]:
            return [(name, None, None, None, None, "parts differ")]
    copies = sum(p[1] == 1 for p in parts)
    if list(by_number) != list(range(1, len(by_number) + 1)):
        return [(name, None, None, None, None, "part missing")] * max(1, copies)
    _, _, url, digest, content_type, _, _ = by_number[1]
    total = by_number[len(by_number)][5]
    block = b"".join(p[6] for p in by_number.values())
    if total != len(block):
        return [(name, url, None, None, None, "total length differs")] * copies
    return [_decoded(name, url, digest, block, content_type, content)] * copies


def payloads(records: DataFrame, content: bool = True) -> DataFrame:
    """record_id, url, payload_bytes, payload_digest (SHA-256, hex), payload, error: one row for each response or resource.

    Parts of a cut record are joined by the number of their origin and verified; a missing part, a wrong total length, a damaged
    chunk or another digest than the stated one is named in `error`. Without `content` payloads are verified and left out.
    Rows that a reader could not make out are passed over here. No rows give no rows.
    """
    schema = _schema(PAYLOAD)
    known = records.where(F.col("type").isin("response", "resource", "continuation"))
    cut = F.col("segment").isNotNull() | (F.col("type") == "continuation")
    columns = ["url", "payload_digest", "content_type", "total_length", "block"]
    whole = known.where(~cut).select("record_id", *columns)
    key = F.coalesce("origin_id", "record_id").alias("record_id")
    parts = known.where(cut).select(key, F.coalesce("segment", F.lit(0)).alias("segment"), *columns)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 5):
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield _rows([_decoded(n, url, digest, block, kind, content) for n, url, digest, kind, _, block in rows], schema)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in bounded(batches, 6):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for _, group in groupby(lines(batches), key=lambda row: row[0]):
            found = _joined(list(group), content)
            waiting += found
            size += sum(500 + len(row[4] or b"") for row in found)
            if size >= BATCH_BYTES:
                yield _rows(waiting, schema)
                waiting, size = [], 0
        if waiting:
            yield _rows(waiting, schema)

    met = parts.repartition("record_id").sortWithinPartitions("record_id", "segment")
    return whole.mapInArrow(decode, PAYLOAD).unionByName(met.mapInArrow(join, PAYLOAD))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, error: every page of archives made by `write`.

    Length and digest of a revisit are those of the payload it refers to, taken from that payload; revisits of a record that is
    not there, or states another digest, say so in `error`.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    found = payloads(read(manifest.where("records > revisits")), content=False)
    revisits = read(manifest.where("revisits > 0")).where("type = 'revisit'").select("record_id", "refers_to", "payload_digest")
    revisits = revisits.withColumnRenamed("payload_digest", "stated")
    firsts = found.select(F.col("record_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to"])
    resolved = joined_to_classes(revisits, firsts, "refers_to", keep=True)
    wrong = F.when(F.col("payload_digest").isNull(), "record missing").when(
        F.concat(F.lit("sha256:"), "payload_digest") != F.col("stated"), "digest differs"
    )
    name = page_of(F.col("record_id")).alias("page_id")
    return found.select(
        name, "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "error"
    ).unionByName(
        resolved.select(
            name,
            "payload_bytes",
            "payload_digest",
            F.lit("revisit").alias("record_type"),
            page_of(F.col("refers_to")).alias("refers_to"),
            wrong.alias("error"),
        )
    )
