"""Legacy archive converter: ARC files to WARC files, and readers and writers for both.

An ARC file opens with a version block (``filedesc://``) that names the fields of its header lines;
version 1 has five, version 2 ten. A record is one header line, as many bytes as its last field
declares, and a line end. ``read_arc`` takes the version and field names of each file from its
version block. ``to_warc`` synthesises what ARC lacks: a record id (a name-based UUID of URL, date
and place), an ISO timestamp from the 14-digit date, a record type from the URL's scheme and the
body, and SHA-1 digests. Of records with equal payloads the one with the smallest page_id is a
response; the others become revisits that refer to it and keep only the HTTP header.

Files are written by Spark's text writer, whose line separator is the record separator of either
format, as gzip streams of at most ``PER_FILE`` records, and read through ``binaryFile``; parsing
inflates a file piece by piece. Record bytes are never decoded.

Null html is an empty payload and null url is "-"; empty payloads are equal to each other. Rows
without page_id come last when the response of a payload is chosen; among repeated rows the place
in the archive decides, so exactly one record of each payload is a response. Other columns are
dropped. An empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtraffic.llm.common import staged
from webtraffic.session import scratch_path

PER_FILE = 4096
DATE = "20000101000000"

# The field names of both versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _plain(url: str | None) -> str:
    """A URL without the characters that end a header field."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def _binary(rows: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["record"])


def _save(records: DataFrame, path: str, separator: str, per_file: int) -> None:
    line = records.select(F.col("record").cast("string").alias("value"))
    out = line.write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "THREE")
    out.option("maxRecordsPerFile", per_file).text(path)


def _with_heads(records: Iterator[bytes], head, per_file: int) -> Iterator[pa.RecordBatch]:
    """Batches of records, with a head before each file's first."""
    out, size, n = [], 0, 0
    for r in records:
        if n % per_file == 0:
            out.append(head(n // per_file))
            n += 1
        out.append(r)
        n += 1
        size += len(r)
        if size > 1 << 22:
            yield _binary(out)
            out, size = [], 0
    if out:
        yield _binary(out)


def http_message(html: bytes, page_id: int | None) -> bytes:
    name = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (name, len(html), html)


def arc_version_block(version: int, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 Origin\n{FIELDS[version]}\n".encode()
    rest = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{rest} {len(body)}\n".encode() + body


def write_arc(pages: DataFrame, path: str, date: str = DATE, per_file: int = PER_FILE) -> None:
    """Write (page_id, url, html) rows as ARC records, version 1 and 2 by turns over the partitions."""

    def run(batches):
        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def records():
            for b in batches:
                for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    body = http_message((html or "").encode(), page_id)
                    extra = "" if version == 1 else f" 200 {hashlib.md5(body).hexdigest()} - 0 part-{part}.arc"
                    yield f"{_plain(url)} 0.0.0.0 {date} text/html{extra} {len(body)}\n".encode() + body

        yield from _with_heads(records(), lambda k: arc_version_block(version, f"part-{part}-{k}.arc", date), per_file)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    _save(rows.mapInArrow(run, "record binary"), path, "\n", per_file)


class Inflated:
    """Reads from the bytes of a file, inflating gzip members piece by piece."""

    def __init__(self, data: bytes, piece: int = 1 << 18):
        self.data, self.piece, self.at = data, piece, 0
        self.z = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
        self.held, self.pos = b"", 0

    def _more(self) -> bool:
        if self.at >= len(self.data) and not (self.z and self.z.unconsumed_tail):
            return False
        source = self.z.unconsumed_tail if self.z else b""
        if not source:
            source = self.data[self.at : self.at + self.piece]
            self.at += len(source)
        if self.z:
            part = self.z.decompress(source, 4 * self.piece)
            if self.z.eof:  # another member may follow
                self.at -= len(self.z.unused_data)
                self.z = zlib.decompressobj(31)
        else:
            part = source
        self.held, self.pos = self.held[self.pos :] + part, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before the next mark, which is passed over; None where the file ends."""
        seen = 0
        while (i := self.held.find(mark, self.pos + seen)) < 0:
            seen = max(0, len(self.held) - self.pos - len(mark) + 1)
            if not self._more():
                return None
        out, self.pos = self.held[self.pos : i], i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.pos < n:
            if not self._more():
                raise ValueError("a record is shorter than its declared length")
        out, self.pos = self.held[self.pos : self.pos + n], self.pos + n
        return out


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number, header fields by name, body) of each record of an ARC file but its version block."""
    f = Inflated(data)
    first = f.until(b"\n")
    if first is None:
        return
    if not first.startswith(b"filedesc://"):
        raise ValueError("an ARC file opens with its version block")
    block = f.take(int(first.rsplit(b" ", 1)[1])).decode().split("\n")
    version, names = int(block[0].split()[0]), block[1].split()
    if names != FIELDS.get(version, "").split():
        raise ValueError(f"ARC version {version} with fields {names}")
    number = 0
    while (line := f.until(b"\n")) is not None:
        if not line:  # between records
            continue
        parts = line.decode("utf-8", "surrogateescape").split(" ")
        if len(parts) != len(names):
            raise ValueError(f"an ARC version {version} header of {len(parts)} fields")
        fields = dict(zip(names, parts, strict=True))
        yield number, fields, f.take(int(fields["Archive-length"]))
        number += 1


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload) of an HTTP message; a body without one is all payload."""
    if body.startswith(b"HTTP/") and (i := body.find(b"\r\n\r\n")) >= 0:
        return body[: i + 4], body[i + 4 :]
    return b"", body


def _page_id(header: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", header)
    return int(m[1]) if m else None


_ARC = {"file": pa.int64(), "number": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "date": pa.string(), "content_type": pa.string(), "payload_digest": pa.string(), "payload_bytes": pa.int64(), "body": pa.binary()}
_ARC_DDL = "file long, number long, page_id long, url string, date string, content_type string, payload_digest string, payload_bytes long, body binary"


def _arrow(rows: list[tuple], schema: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
    return files.select(F.xxhash64("path").alias("file"), "content")


def read_arc(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records of ARC files: place, header fields, payload digest and length, and the body."""

    def run(batches):
        for b in batches:
            rows, size = [], 0
            for file, data in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                for number, fields, body in arc_records(data.as_py()):
                    header, payload = split_http(body)
                    rows.append((file, number, _page_id(header), fields["URL"], fields["Archive-date"], fields["Content-type"], digest(payload), len(payload), body if bodies else None))
                    size += len(body) if bodies else 64
                    if size > 1 << 22:
                        yield _arrow(rows, _ARC)
                        rows, size = [], 0
            if rows:
                yield _arrow(rows, _ARC)

    return _files(spark, path).mapInArrow(run, _ARC_DDL)


def record_types(records: DataFrame) -> DataFrame:
    """(file, number, first): first is the struct (page_id, file, number) of the record of the same
    payload that comes first by page_id, null last, then place.

    The digests' firsts are aggregated before the shuffle and written; the join's skew is split.
    """
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "number")
    slim = staged(records.select("file", "number", "page_id", "payload_digest"), "slim")
    firsts = staged(slim.groupBy("payload_digest").agg(F.min(place).alias("first")), "firsts")
    return slim.join(firsts, "payload_digest").select("file", "number", "first")


def warc_date(date: str) -> str:
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, file: int, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {file}:{number}')}>"


def warc_type(url: str, body: bytes) -> tuple[str, str]:
    """(record type, content type) for an ARC record: its scheme and body decide."""
    if body.startswith(b"HTTP/"):
        return "response", "application/http; msgtype=response"
    return "resource", "text/dns" if url.startswith("dns:") else "application/octet-stream"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record without the two line ends that close it."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode("utf-8", "surrogateescape") + b"\r\n" + block


def warcinfo(name: str, date: str = DATE) -> bytes:
    block = b"format: WARC File Format 1.0\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", warc_date(date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return warc_record(fields, block)


def converted(row: dict) -> bytes:
    """The WARC record of one ARC record; ``first`` is the place of the record it equals, or itself."""
    url, body, first = row["url"], row["body"], row["first"]
    kind, content = warc_type(url, body)
    own = first["file"] == row["file"] and first["number"] == row["number"]
    fields = [
        ("WARC-Type", kind if own else "revisit"),
        ("WARC-Record-ID", record_id(url, row["date"], row["file"], row["number"])),
        ("WARC-Target-URI", url), ("WARC-Date", warc_date(row["date"])),
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
    ]
    if row["page_id"] is not None:
        fields.append(("X-Page-Id", str(row["page_id"])))
    block = body
    if not own:
        block = split_http(body)[0]
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))
        fields.append(("X-Payload-Length", str(row["payload_bytes"])))
        if first["page_id"] is not None:
            fields.append(("X-Refers-To-Page-Id", str(first["page_id"])))
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", content)]
    return warc_record(fields, block)


def to_warc(records: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Write ARC records (with ``first``) as WARC files."""

    def run(batches):
        part = TaskContext.get().partitionId()

        def all_records():
            for b in batches:
                yield from map(converted, b.to_pylist())

        yield from _with_heads(all_records(), lambda k: warcinfo(f"part-{part}-{k}.warc"), per_file)

    _save(records.mapInArrow(run, "record binary"), path, "\r\n\r\n", per_file)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of a WARC file."""
    f = Inflated(data)
    while (line := f.until(b"\r\n")) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record opens with its version")
        head = f.until(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogateescape").split("\r\n"))
        yield fields, f.take(int(fields["Content-Length"]))


_WARC = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "url": pa.string(), "date": pa.string()}
_WARC_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but warcinfo. Payload length and digest of responses are those of the
    bytes read; a digest that differs from the record's own raises. Revisits have those declared."""

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column("content"):
                for fields, block in warc_records(data.as_py()):
                    kind, said = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    if kind == "warcinfo":
                        continue
                    if kind == "revisit":
                        size, found = int(fields["X-Payload-Length"]), said
                    else:
                        payload = split_http(block)[1]
                        size, found = len(payload), digest(payload)
                        if found != said:
                            raise ValueError(f"digest of {fields['WARC-Record-ID']}")
                    number = lambda k: int(fields[k]) if k in fields else None
                    rows.append((number("X-Page-Id"), size, found, kind, number("X-Refers-To-Page-Id"), fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"]))
                if len(rows) > 10_000:
                    yield _arrow(rows, _WARC)
                    rows = []
            if rows:
                yield _arrow(rows, _WARC)

    return _files(spark, path).mapInArrow(run, _WARC_DDL)


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """ARC files to WARC files."""
    types = staged(record_types(read_arc(spark, arc_path, bodies=False)), "types")
    to_warc(read_arc(spark, arc_path).join(types, ["file", "number"]), warc_path)


def archived(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` as ARC, convert to WARC and read that: one row per page."""
    spark = pages.sparkSession
    arc, warc = (scratch_path(spark, "llm", x) for x in ("arc", "warc"))
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
