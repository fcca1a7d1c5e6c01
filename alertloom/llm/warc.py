"""WARC records in ZIP packages: writer, and a reader that works by byte ranges.

A package is a ZIP file with two stored (not deflated) members, so their bytes can
be addressed without extraction: `archive/data.warc.gz`, one gzip member per
record, and `indexes/index.cdxj`, one line per record with offset and length.
The reader finds the end-of-directory record, follows ZIP64 records where sizes
or counts overflow, walks the central directory to the two members, reads the
index by ranges and then the records of each range.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.bytetext import sub_batches
from alertloom.llm.files import RangeReader, create
from alertloom.storage import materialise, scratch_path

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ROLL_RECORDS, ROLL_BYTES = 50_000, 1 << 29  # a package is closed beyond either
READ_BYTES = 4 << 20  # bytes of records that one read takes at least, if there are as many
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

PACKAGES = "path string, records long, bytes long"
RANGES = "path string, offset long, lengths array<long>"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, record_offset long"


# Writing


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record_bytes(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, but not the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


class _Sink:
    """A stream that only goes forward, so that the ZIP writer adds data descriptors."""

    def __init__(self, stream: Any):
        self.stream, self.count = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.count += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class PackageWriter:
    """Writes one package; index lines wait in memory, so packages are of bounded size."""

    def __init__(self, uri: str):
        self.uri, self.stream = uri, create(uri)
        self.sink = _Sink(self.stream)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)  # type: ignore[arg-type]
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> None:
        deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = deflate.compress(record_bytes(page, url, payload, refers_to, revisit)) + deflate.flush()
        self.member.write(data)
        key = _record_id(page)[1:-1]
        self.lines.append(f"{key} {re.sub('[^0-9]', '', DATE)} " + json.dumps({"offset": self.at, "length": len(data), "filename": ARCHIVE.rpartition("/")[2]}))
        self.at += len(data)

    @property
    def full(self) -> bool:
        return len(self.lines) >= ROLL_RECORDS or self.at >= ROLL_BYTES

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as member:
            member.write("".join(line + "\n" for line in self.lines).encode())
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.sink.count


def mark_copies(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to, revisit.

    Among equal payloads of at least min_bytes bytes the row with the largest id is
    the response. Rows that repeat that id are responses too, and so are copies none
    of which has an id. A null payload is empty.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    groups = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur twice are looked up. Both sides of the join are plain
    # reads, so that Spark may broadcast a small one or split a hot payload.
    copies = materialise(groups.where("n > 1 and keeper is not null").select(F.col("sha").alias("copied"), "keeper"), "copied-payloads")
    marked = rows.join(copies, rows["sha"] == copies["copied"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return marked.select("page_id", "url", "payload", F.when(revisit, F.col("keeper")).alias("refers_to"), revisit.alias("revisit"))


def write_packages(marked: DataFrame, root: str) -> DataFrame:
    """Writes every row as a record; returns one row per finished package."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer = TaskContext.get().partitionId(), None
        done = []
        for batch in sub_batches(batches, 2):
            ids, urls, payloads, refers, revisits = (c.to_pylist() for c in batch.columns)
            for page, url, payload, refers_to, revisit in zip(ids, urls, payloads, refers, revisits, strict=True):
                writer = writer or PackageWriter(f"{root}/pages-{part:06d}-{uuid.uuid4().hex}.zip")
                writer.add(page, url, payload.encode(), refers_to, revisit)
                if writer.full:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d, strict=True)) for d in done])

    return materialise(marked.mapInArrow(write, PACKAGES), "packages")


# Reading


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """Replaces the values that overflowed 32 bits by those in the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + size
    return values


def central_directory(file: RangeReader) -> list[Member]:
    """All members, from the end of the file backwards."""
    tail = min(file.size, 22 + 0xFFFF + 20)
    data = file.at(file.size - tail, tail)
    end = data.rfind(b"PK\x05\x06")
    # The mark may also stand in the comment; the real one states the comment's length.
    while end >= 0 and data[end + 20 : end + 22] != (len(data) - end - 22).to_bytes(2, "little", signed=len(data) < end + 22):
        end = data.rfind(b"PK\x05\x06", 0, end + 3)
    if end < 0:
        raise ValueError("no ZIP directory")
    count, size, start = struct.unpack_from("<HII", data, end + 10)
    where = file.size - tail + end
    if 0xFFFF == count or 0xFFFFFFFF in (size, start) or (where >= 20 and file.at(where - 20, 4) == b"PK\x06\x07"):
        mark, _, far, _ = struct.unpack("<4sIQI", file.at(where - 20, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = file.at(far, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 directory record")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    directory, members, at = file.at(start, size), [], 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged ZIP directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, names, extras, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + names].decode("utf-8", "replace")
        plain, packed, header = _zip64(directory[at + 46 + names : at + 46 + names + extras], [plain, packed, header])
        members.append(Member(name, method, packed, header))
        at += 46 + names + extras + comment
    return members


def data_offset(file: RangeReader, member: Member) -> int:
    """Where a member's bytes begin: its local header has lengths of its own."""
    head = file.at(member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + names + extras


def index_lines(file: RangeReader, member: Member, step: int = READ_BYTES) -> Iterator[dict]:
    """Entries of a stored index, read in steps."""
    start, rest = data_offset(file, member), b""
    for at in range(0, member.size, step):
        rest += file.at(start + at, min(step, member.size - at))
        *lines, rest = rest.split(b"\n")
        for line in lines:
            yield json.loads(line.split(b" ", 2)[2])


def record_ranges(path: str, file: RangeReader) -> Iterator[tuple[str, int, list[int]]]:
    """(path, offset in the package, lengths) of records that follow each other."""
    members = {m.name: m for m in central_directory(file)}
    for index in [m for name, m in members.items() if name.startswith("indexes/") and m.method == 0]:
        base, start, end, where, lengths = 0, 0, 0, None, []
        for entry in index_lines(file, index):
            if lengths and (where != entry["filename"] or end - start >= READ_BYTES or entry["offset"] != end):
                yield path, base + start, lengths
                lengths = []
            if where != entry["filename"]:
                archive = members["archive/" + entry["filename"]]
                if archive.method:
                    raise ValueError(f"{archive.name} is not stored")
                where, base = entry["filename"], data_offset(file, archive)
            if not lengths:
                start = entry["offset"]
            lengths.append(entry["length"])
            end = entry["offset"] + entry["length"]
        if lengths:
            yield path, base + start, lengths


def _headers(data: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in data.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """Fields of one record; a response's digest is taken from its payload and compared."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        if digest != stated:
            raise ValueError(f"digest of {fields['warc-record-id']} differs")
    else:
        digest, size = stated, int(_headers(http)["content-length"])
    return {"page_id": _page(fields["warc-record-id"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to"))}


def read_packages(packages: DataFrame) -> DataFrame:
    """One row per record of the packages named in column path."""
    names = [f.split()[0] for f in FOUND.split(", ")]
    kinds = pa.schema([(n, pa.string() if n in ("payload_digest", "record_type", "path") else pa.int64()) for n in names])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with RangeReader(path) as file:
                    found = list(record_ranges(path, file))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found, strict=True)], ["path", "offset", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with RangeReader(row["path"]) as file:
                    data = memoryview(file.at(row["offset"], sum(row["lengths"])))
                out, at = [], 0
                for length in row["lengths"]:
                    record = zlib.decompress(data[at : at + length], 31)
                    out.append(parse_record(record) | {"path": row["path"], "record_offset": row["offset"] + at})
                    at += length
                yield pa.RecordBatch.from_pylist(out, kinds)

    def spread(rows: DataFrame, by: list[str]) -> DataFrame:
        """One row is one file or range to read: dealt by count, whatever its size."""
        return rows.repartition(max(1, min(rows.count(), 20_000)), *by)

    found = materialise(spread(packages.select("path"), ["path"]).mapInArrow(ranges, RANGES), "record-ranges")
    return spread(found, ["path", "offset"]).mapInArrow(read, FOUND)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to packages and reads every record back."""
    root = scratch_path(pages.sparkSession, "packages")
    return read_packages(write_packages(mark_copies(pages, min_bytes), root))
