"""Legacy ARC archives turned into WARC.

An ARC file is a sequence of records: a header line of blank-separated fields, that many bytes of content as its last field
says, and a line feed. Its first record, the version block, names the version and the fields: version 1 has ``URL IP-address Archive-date
Content-type Archive-length``, version 2 adds ``Result-code Checksum Location Offset Filename`` before the length. The reader goes from record to
record by the declared lengths alone, so content may hold anything.

The converter makes what WARC wants and ARC lacks: record identifiers (UUIDs from archive name and byte offset, the same in
every run), ISO timestamps from 14-digit dates, record types (``warcinfo`` from the version block; ``response``, or ``revisit`` of an
identical payload; ``resource`` for anything not fetched by HTTP), and SHA-1 block and payload digests.

Archives are written by Spark's text writer (gzip, one file per task, published when the job commits), so they can lie in any
file system that Spark knows, and are read one file at a time, decompressed as a stream. Which of equal payloads is the response is decided over a small
table of digests, with the groups reduced before the shuffle; payloads are shuffled only if that table is too large to broadcast.

Edge cases: null content is empty; null URLs, dates and page ids are left out or written ``-`` and read back as null; rows with equal ids are all
written, and the identifiers tell them apart; blanks and control characters in URLs are percent-encoded; an empty table makes archives without records; a cut-off record is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import bounded_batches, stored
from marquee.session import fresh_path

# Field names and version lines of the ARC formats, and the WARC profile of identical payloads.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

PAGE_HEADER = "X-Page-Id"
READ_BYTES = 1 << 18


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _url(text: str | None) -> str:
    return urllib.parse.quote(text, safe="!#$%&'()*+,/:;=?@[]~-._") if text else "-"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 marquee\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain", *(["200", "-", "-", "0", name] if version == 2 else []), str(len(body))]
    return " ".join(fields).encode() + b"\n" + body


def arc_record(version: int, name: str, url: str | None, date: str, content: bytes, mime: str = "text/html") -> bytes:
    more = ["200", "-", "-", "0", name] if version == 2 else []
    return " ".join([_url(url), "0.0.0.0", date, mime, *more, str(len(content))]).encode() + b"\n" + content


def http_message(page_id: int | None, payload: bytes) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"{PAGE_HEADER}: {page_id}\r\n" if page_id is not None else "")
    return head.encode() + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload


class Stream:
    """Exact reads from gzip or plain bytes, decompressed as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.position = memoryview(data), 0, 0
        self.buffer, self.start = b"", 0  # what is read but not taken begins at start
        self.gzip = bytes(data[:2]) == b"\x1f\x8b"
        self.inflater = zlib.decompressobj(31) if self.gzip else None

    def _more(self) -> bytes:
        if not self.gzip:
            part = bytes(self.data[self.at : self.at + READ_BYTES])
            self.at += len(part)
            return part
        while True:
            if self.inflater.eof:  # another member may follow
                rest = self.inflater.unused_data
                self.at -= len(rest)
                self.inflater = zlib.decompressobj(31)
            raw = bytes(self.data[self.at : self.at + READ_BYTES])
            if not raw:
                return b""
            self.at += len(raw)
            if part := self.inflater.decompress(raw):
                return part

    def line(self, end: bytes) -> bytes | None:
        """The bytes up to ``end``, without it; null at the end of the file."""
        found = self.buffer.find(end, self.start)
        while found < 0:
            part = self._more()
            if not part:
                if self.start < len(self.buffer):
                    raise ValueError("an archive ends within a header")
                return None
            self.buffer, self.start = self.buffer[self.start :] + part, 0
            found = self.buffer.find(end)
        line = self.buffer[self.start : found]
        self.position += found + len(end) - self.start
        self.start = found + len(end)
        return line

    def take(self, n: int) -> bytes:
        have = len(self.buffer) - self.start
        if have < n:
            parts = [self.buffer[self.start :]]
            while have < n:
                part = self._more()
                if not part:
                    raise ValueError("an archive ends within a record")
                parts.append(part)
                have += len(part)
            self.buffer, self.start = b"".join(parts), 0
        data = self.buffer[self.start : self.start + n]
        self.start += n
        self.position += n
        return data


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, named header fields and content of each record, the version block first."""
    stream = Stream(data)
    fields: list[str] = []
    while True:
        offset = stream.position
        line = stream.line(b"\n")
        if line is None:
            return
        if not line.strip():
            continue
        words = line.decode("utf-8", "replace").split(" ")
        content = stream.take(int(words[-1]))
        if words[0].startswith("filedesc://"):
            version, _, rest = content.decode("latin-1").partition("\n")
            fields = rest.split("\n")[0].split(" ")
            yield offset, {"URL": words[0], "Archive-date": words[2], "version": version.split(" ")[0]}, content
            continue
        if len(words) != len(fields):
            raise ValueError(f"a header has {len(words)} fields in place of {len(fields)}: {line[:200]!r}")
        yield offset, dict(zip(fields, words)), content


def payload_of(content: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP headers (lower-case names) and body; no headers if it is no HTTP message."""
    if not content.startswith(b"HTTP/"):
        return {}, content
    head, _, body = content.partition(b"\r\n\r\n")
    pairs = (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    return {"": "http", **{k.strip().lower(): v.strip() for k, _, v in pairs}}, body


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_date(date: str) -> str | None:
    """ISO form of an ARC date of 14 digits, or 8 in old files."""
    if not re.fullmatch(r"\d{8}|\d{14}", date):
        return None
    date = date.ljust(14, "0")
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:]}Z"


def warc_record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record without its last line end, which the writer adds."""
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    return ("WARC/1.0\r\n" + "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n"


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    stream = Stream(data)
    while (first := stream.line(b"\r\n")) is not None:
        if not first:
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {first[:80]!r}")
        headers = {}
        while line := stream.line(b"\r\n"):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.take(int(headers["content-length"]))


def _write(records: DataFrame, path: str, line_end: str) -> None:
    """Records (binary column ``record``) to gzip files, one per task."""
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", line_end).option(
        "compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, schema.types)], schema=schema)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20200102030405") -> None:
    """Pages as HTTP responses in ARC files, of version 1 and 2 by turns."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:06d}.arc.gz"
        fresh = True
        for batch in batches:
            made = [arc_version_block(version, name, date)] if fresh and len(batch) else []
            fresh = fresh and not len(batch)
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                made.append(arc_record(version, name, url, date, http_message(page_id, (html or "").encode())))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    _write(pages.select(id_col, url_col, html_col).mapInArrow(run, "record binary"), path, "\n")


ENTRY = "archive string, position long, page_id long, warc_id string, payload_bytes long, payload_digest string"


def index_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per ARC record but the version blocks: where it is, its page id, the identifier it will have, and its payload's size and digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                name = archive.rsplit("/", 1)[-1]
                for offset, fields, content in arc_records(data.as_buffer().to_pybytes()):
                    if "version" not in fields:
                        http, payload = payload_of(content)
                        page = http.get(PAGE_HEADER.lower())
                        rows.append((archive, offset, int(page) if page else None, record_id(name, offset), len(payload), sha1(payload)))
                yield _batch(rows, INDEX_SCHEMA)

    return _files(spark, path).mapInArrow(run, ENTRY)


INDEX_SCHEMA = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("warc_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def revisits(index: DataFrame, at_least: int = 0) -> DataFrame:
    """Of records with equal payloads of at least so many bytes, those that are not the one with the largest page id (then identifier): warc_id, and the response's identifier and page id."""
    large = index.where(F.col("payload_bytes") >= at_least)
    best = F.struct("page_id", "warc_id")
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.max(best).alias("best"), F.min(best).alias("least")).where("best <> least")
    joined = large.join(groups.select("payload_digest", "payload_bytes", "best"), ["payload_digest", "payload_bytes"])
    return joined.where(F.col("warc_id") != F.col("best.warc_id")).select(
        "warc_id", F.col("best.warc_id").alias("response_id"), F.col("best.page_id").alias("response_page"))


def convert(spark: SparkSession, arc: str, warc: str, at_least: int = 0) -> DataFrame:
    """Write WARC files from ARC files; returns the table of revisits."""
    bounded_batches(spark)
    again = stored(revisits(stored(index_arc(spark, arc), "arc-index"), at_least), "arc-revisits")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, rows, size = archive.rsplit("/", 1)[-1], [], 0
                for offset, fields, content in arc_records(data.as_buffer().to_pybytes()):
                    rows.append((record_id(name, offset), fields["URL"], fields["Archive-date"], fields.get("Content-type"), "version" in fields, content))
                    size += len(content)
                    if size > READ_BYTES:
                        yield _batch(rows, RECORD_SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, RECORD_SCHEMA)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for warc_id, url, date, mime, info, content, response_id in zip(*(c.to_pylist() for c in batch.columns)):
                common = [("WARC-Record-ID", warc_id), ("WARC-Date", warc_date(date))]
                if info:
                    text = b"software: marquee\r\nformat: WARC File Format 1.0\r\n"
                    made.append(warc_record([("WARC-Type", "warcinfo"), *common, ("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "application/warc-fields")], text))
                    continue
                http, payload = payload_of(content)
                kind = "revisit" if response_id else "response" if http else "resource"
                block = content[: len(content) - len(payload)] if response_id else content
                made.append(warc_record([
                    ("WARC-Type", kind), *common, ("WARC-Target-URI", None if url == "-" else url), ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"),
                    ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("WARC-Refers-To", response_id), ("WARC-Profile", REVISIT_PROFILE if response_id else None),
                    ("Content-Type", "application/http; msgtype=response" if http else mime),
                ], block))
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    records = _files(spark, arc).mapInArrow(parse, "warc_id string, url string, date string, mime string, info boolean, content binary")
    marked = records.join(again.select("warc_id", "response_id"), "warc_id", "left")
    _write(marked.mapInArrow(build, "record binary"), warc, "\r\n")
    return again


RECORD_SCHEMA = pa.schema([("warc_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("info", pa.bool_()), ("content", pa.binary())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but warcinfo: its type, identifier, target, date, page id, the response it refers to, and its payload's size and digest.

    Payloads are digested anew and must agree with the header; a revisit has the declared digest and, until it is resolved, no size.
    """
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                rows = []
                for headers, block in warc_records(data.as_buffer().to_pybytes()):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, payload = payload_of(block)
                    page, digest = http.get(PAGE_HEADER.lower()), headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and sha1(payload) != digest:
                        raise ValueError(f"payload digest of {headers['warc-record-id']} differs")
                    rows.append((kind, headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-date"), int(page) if page else None,
                                 headers.get("warc-refers-to"), None if kind == "revisit" else len(payload), digest))
                yield _batch(rows, READ_SCHEMA)

    return _files(spark, path).mapInArrow(run, "record_type string, warc_id string, url string, date string, page_id long, refers_to_id string, payload_bytes long, payload_digest string")


READ_SCHEMA = pa.schema([("record_type", pa.string()), ("warc_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()),
                         ("refers_to_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def resolved(records: DataFrame) -> DataFrame:
    """Records with ``payload_bytes`` and ``refers_to`` (page id) of revisits filled in from the responses they name."""
    named = records.where(F.col("refers_to_id").isNotNull()).select(F.col("refers_to_id").alias("response_id")).distinct()
    responses = records.join(named, F.col("warc_id") == F.col("response_id"), "left_semi").select(
        F.col("warc_id").alias("response_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("response_bytes"))
    joined = records.join(responses, F.col("refers_to_id") == F.col("response_id"), "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "response_bytes")).drop("response_id", "response_bytes")


def op1_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC files into WARC files, read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    records = resolved(stored(read_warc(spark, warc), "warc-records"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "date", "warc_id")
