"""Web pages to WARC records in ZIP packages, and a reader that fetches records by range.

A package is a ZIP of stored members: ``archive/data.warc.gz`` (a gzip member for each record),
``indexes/index.cdxj`` (a JSON line for each record: offset and length) and ``datapackage.json``. The reader
finds the central directory from the end (its ZIP64 form too), takes a member's place from its local
header, reads the index, and then fetches each record by its range; nothing is extracted.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a
response, the others are revisits that refer to it; smaller payloads are all responses. A revisit
keeps the HTTP header with the payload's length. Null html counts as empty, null urls get the name of
the record as their address. Rows that repeat the smallest page_id of a payload are all responses.
Null page_ids are kept, and are never referred to unless all of the payload's are null; then all are
responses. An empty table gives no package and no row.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, new_folder, open_store, to_batch, with_group_figures, written

DATA, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Bytes of WARC data after which a package is closed and another begun.
PACKAGE_BYTES = 64 << 20
#: Bytes of neighbouring records fetched at a time.
FETCH_BYTES = 4 << 20
EMPTY_DATE = "1970-01-01T00:00:00Z"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    found = name.strip("<>").rpartition(":")[2]
    return int(found) if found else None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not yet compressed. refers_to given: a revisit."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {EMPTY_DATE}", f"WARC-Target-URI: {_line(url) if url else record_name(page_id).strip('<>')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class PackageWriter:
    """Writes one package to a stream that can't seek; holds the index in memory."""

    def __init__(self, sink):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.size, self.index = self.zip.open(DATA, "w", force_zip64=True), 0, []

    def add(self, page_id: int | None, whole: bytes) -> None:
        packed = gzip_member(whole)
        self.data.write(packed)
        self.index.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.writestr(ABOUT, json.dumps({"profile": "web-archive-package", "records": len(self.index)}))
        self.zip.close()


@dataclass(frozen=True)
class Member:
    name: str
    size: int
    header: int  # place of its local header


class PackageReader:
    """Central directory, stored members and records of a package, by range reads."""

    def __init__(self, source, fetch_bytes: int = FETCH_BYTES):
        self.source, self.fetch_bytes = source, fetch_bytes
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        size = self.source.size()
        back = min(size, 65_557)  # the end record and the longest comment
        tail = self.source.read_at(back, size - back)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
            (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            found = self.source.read_at(56, end64)
            if found[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            n, length, start = struct.unpack("<QQQ", found[32:56])
        raw, at = self.source.read_at(length, start), 0
        for _ in range(n):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack("<HH", raw[at + 8 : at + 12])
            packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
            (header,) = struct.unpack("<I", raw[at + 42 : at + 46])
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                tag, room = struct.unpack("<HH", extra[:4])
                if tag == 1:  # ZIP64: the fields that did not fit, in this order
                    wide = iter(struct.unpack(f"<{room // 8}Q", extra[4 : 4 + room // 8 * 8]))
                    plain, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, header))
                extra = extra[4 + room :]
            if method == 0:
                yield Member(name, packed, header)
            at += 46 + n_name + n_extra + n_comment

    def place(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        m = self.members[name]
        head = self.source.read_at(30, m.header)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("damaged local header")
        return m.header + 30 + sum(struct.unpack("<HH", head[26:30]))

    def index(self) -> Iterator[dict]:
        raw = self.source.read_at(self.members[INDEX].size, self.place(INDEX))
        return map(json.loads, raw.decode().splitlines())

    def fetch(self, offset: int, length: int) -> bytes:
        """One record, unpacked."""
        return zlib.decompress(self.source.read_at(length, self.place(DATA) + offset), 31)

    def records(self) -> Iterator[tuple[dict, bytes]]:
        """(headers, payload) of every record that the index lists; neighbours are fetched together."""
        place, run, start = self.place(DATA), [], 0
        for entry in [*self.index(), None]:
            if run and (entry is None or entry["offset"] + entry["length"] - start > self.fetch_bytes or entry["offset"] != run[-1]["offset"] + run[-1]["length"]):
                raw = self.source.read_at(run[-1]["offset"] + run[-1]["length"] - start, place + start)
                for e in run:
                    a = e["offset"] - start
                    yield parse(zlib.decompress(raw[a : a + e["length"]], 31))
                run = []
            if entry is not None:
                start = start if run else entry["offset"]
                run.append(entry)


def parse(whole: bytes) -> tuple[dict, bytes]:
    """Headers (names in lower case; those of HTTP with http: before them) and payload of a record."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers |= {f"http:{k.lower()}": v for k, _, v in (line.partition(": ") for line in http.decode().split("\r\n")[1:])}
    return headers, payload


def write_packages(pages: DataFrame, least: int = 0, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as packages; returns the manifest, already written: path, records.

    The html is moved once, dealt by its digest and a hash of the row, so that a payload with a third of all
    rows spreads over all tasks. Each attempt of a task writes packages of its own; the manifest
    names those that counted.
    """
    spark = pages.sparkSession
    arrow_limits(spark, 1000)
    folder = folder or new_folder(spark, "warc")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # The digest alone decides which payloads are equal; smaller ones have a key for each row.
    keyed = slim.withColumn("key", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8"))).otherwise(F.concat_ws(" ", F.lit("own"), F.col("page_id").cast("string"), F.xxhash64("url", "html").cast("string"))))
    row = F.xxhash64("page_id", "url")
    ready = with_group_figures(keyed, "key", row, {"first": (F.col("page_id"), "min")})
    ready = ready.select("page_id", "url", "html", F.when((F.octet_length("html") >= least) & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                if writer is None:
                    uri = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
                    store, path = open_store(uri)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(path)
                    writer = PackageWriter(sink)
                payload = html.as_buffer().to_pybytes()
                writer.add(page_id, record(page_id, url, payload, digest_of(payload), refers_to))
                if writer.size >= package_bytes:
                    writer.close()
                    sink.close()
                    done.append((uri, len(writer.index)))
                    writer = None
        if writer is not None:
            writer.close()
            sink.close()
            done.append((uri, len(writer.index)))
        if done:
            yield to_batch(done, schema)

    return written(ready.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """Per record of the packages: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A response's digest is worked out from its payload and must be the one it names.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def row(headers: dict, payload: bytes) -> tuple:
        kind, named = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
        size = int(headers["http:content-length"])
        if kind == "response" and (digest_of(payload) != named or len(payload) != size):
            raise ValueError(f"damaged record {headers['warc-record-id']}")
        refers_to = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
        return page_of(headers["warc-record-id"]), size, named, kind, refers_to, headers["warc-target-uri"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = open_store(uri)
                with store.open_input_file(path) as source:
                    rows = []
                    for headers, payload in PackageReader(source).records():
                        rows.append(row(headers, payload))
                        if len(rows) == 10_000:
                            yield to_batch(rows, schema)
                            rows = []
                    if rows:
                        yield to_batch(rows, schema)

    packages = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(packages, "path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
