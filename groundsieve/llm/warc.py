"""WARC archives: a deduplicating writer and a salvage reader.

Writer: each page becomes a record, a gzip member of its own. Of the pages with
equal payloads (at least ``min_payload`` bytes long) the one with the largest id
is a response; the others are revisits, which carry the digest and length
of the payload and name the page they refer to, but no payload. Groups
of equal payloads are found from digests alone.

Reader: every record is checked (gzip checksum, version line, header, length,
end of the record, payload digest). After a failed check the reader searches on
from the next byte for a gzip member that begins with a version line, or for a
version line (anywhere, since damage may have taken the line break before it),
and goes on from there; the bytes between are reported as a gap with the reason. Compressed and plain records may be mixed.
A file is read in chunks; memory holds one record.

Defined results: a null payload is empty; a page without an id never is the one
referred to, and of several rows with the largest id all are responses; a null
url leaves the target header out; an empty table gives no files; other columns
are ignored; a record longer than ``max_record`` bytes is a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.common import file_system, new_folder
from groundsieve.sources.staging import stage

_END = b"\r\n\r\n"
_GZIP = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_CHUNK = 1 << 20
_HEADER_LIMIT = 1 << 16
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.\d\r\n")
_RECORD = ("path string, at long, size long, reason string, page_id long, record_type string, "
           "target_uri string, payload_digest string, payload_bytes long, refers_to long")


@dataclass(frozen=True)
class WarcOptions:
    min_payload: int = 0           # smaller payloads are always responses
    date: str = "2024-01-01T00:00:00Z"
    level: int = 6
    file_bytes: int = 64 * 1024 * 1024
    max_record: int = 1 << 30
    compressed: bool = True


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def warc_record(page: dict, options: WarcOptions) -> bytes:
    """The record of a page with page_id, url, payload, sha1 (hexadecimal), bytes and refers_to."""
    digest = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
    revisit = page["record_type"] == "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['bytes']}\r\n\r\n"
    block = head.encode() + (b"" if revisit else (page["payload"] or "").encode())
    fields = {"WARC-Type": page["record_type"], "WARC-Record-ID": _record_id(page["page_id"]),
              "WARC-Date": options.date}
    if page["url"] is not None:
        fields["WARC-Target-URI"] = _one_line(page["url"])
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = _record_id(page["refers_to"])
        fields["X-Refers-To-Page"] = page["refers_to"]
    fields |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Bytes": page["bytes"]}
    if page["page_id"] is not None:
        fields["X-Page-Id"] = page["page_id"]
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    record = f"WARC/1.1\r\n{lines}\r\n".encode() + block + _END
    if not options.compressed:
        return record
    packer = zlib.compressobj(options.level, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def with_record_types(pages: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """page_id, url, payload, sha1, bytes, record_type and refers_to of each page."""
    payload = F.coalesce(pages["html"], F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"),
                        payload.alias("payload"))
    sha1, size = F.sha1(F.col("payload").cast("binary")), F.octet_length("payload").cast("long")
    large = rows.where(size >= options.min_payload).select("page_id", sha1.alias("sha1"))
    shared = stage(large.groupBy("sha1").agg(
        F.max("page_id").alias("first"), F.count("*").alias("n")).where(
        "n > 1 and first is not null").select("sha1", "first"), "shared-payloads")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")) & (
        F.col("bytes") >= options.min_payload)
    return rows.withColumn("sha1", sha1).withColumn("bytes", size).join(shared, "sha1", "left").select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "sha1", "bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Writes the archives; returns a row for each file: path, records, bytes."""
    folder = new_folder(pages.sparkSession, "warc")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = file_system(folder)
        scheme = folder[: len(folder) - len(inner)]
        out, files = None, []
        for batch in batches:
            for n in range(batch.num_rows):
                (page,) = batch.slice(n, 1).to_pylist()
                if out is None:
                    fs.create_dir(inner, recursive=True)
                    path = f"{inner}/{uuid.uuid4().hex}.warc" + ".gz" * options.compressed
                    out = fs.open_output_stream(path, compression=None)
                    files.append({"path": scheme + path, "records": 0, "bytes": 0})
                record = warc_record(page, options)
                out.write(record)
                files[-1]["records"] += 1
                files[-1]["bytes"] += len(record)
                if files[-1]["bytes"] >= options.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=schema)

    rows = with_record_types(pages, options)
    return stage(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-files")


class BadRecord(Exception):
    pass


class _Window:
    """A file read front to back in chunks, with a view of the bytes from ``at`` on."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        self.size = self.file.size()
        self.base, self.data = 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to n bytes from ``at``."""
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.base or at + n > self.base + len(self.data):
            self.base, self.data = at, self.file.read_at(max(n, _CHUNK), at)
        return self.data[at - self.base: at - self.base + n]


def _parse(record: bytes) -> dict:
    """Checks a whole record and returns its fields."""
    head, found, block = record.partition(_END)
    lines = head.split(b"\r\n")
    if not found or not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        raise BadRecord("version line or header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("header line")
        fields[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    length = fields.get(b"content-length", "")
    if not length.isdigit() or len(block) != int(length) + len(_END) or not block.endswith(_END):
        raise BadRecord("length")
    payload = block[: -len(_END)].partition(_END)[2]
    kind, digest = fields.get(b"warc-type"), fields.get(b"warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and digest and digest != base32_sha1(payload):
        raise BadRecord("payload digest")

    def number(name):
        value = fields.get(name, "")
        return int(value) if re.fullmatch(r"-?\d+", value) else None

    size = number(b"x-payload-bytes") if kind == "revisit" else len(payload)
    return {"page_id": number(b"x-page-id"), "record_type": kind, "target_uri": fields.get(b"warc-target-uri"),
            "payload_digest": digest or None, "payload_bytes": size,
            "refers_to": number(b"x-refers-to-page"), "payload": payload}


def _member(source: _Window, at: int, limit: int) -> tuple[bytes, int]:
    """The content and the size of the gzip member at a place."""
    unpack, parts, total, place = zlib.decompressobj(31), [], 0, at
    while not unpack.eof:
        chunk = source.get(place, 1 << 16)
        if not chunk:
            raise BadRecord("truncated member")
        try:
            parts.append(unpack.decompress(chunk, limit + 1 - total))
        except zlib.error as error:
            raise BadRecord(f"gzip: {error}") from None
        total += len(parts[-1])
        if total > limit:
            raise BadRecord("too long")
        place += len(chunk)
    return b"".join(parts), place - len(unpack.unused_data) - at


def _plain(source: _Window, at: int, limit: int) -> tuple[bytes, int]:
    """The bytes and the size of the uncompressed record at a place."""
    head = source.get(at, _HEADER_LIMIT)
    end = head.find(_END)
    length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\s*(?:\r\n|\Z)", head[: max(end, 0)])
    if end < 0 or not length or int(length[1]) > limit:
        raise BadRecord("header or length")
    size = end + len(_END) + int(length[1]) + len(_END)
    record = source.get(at, size)
    if len(record) < size:
        raise BadRecord("truncated record")
    return record, size


def _next_start(source: _Window, at: int) -> int:
    """The next place from ``at`` on where a record may start; the file's size if none."""
    while at < source.size:
        chunk = source.get(at, _CHUNK)
        for m in _START.finditer(chunk):
            place = at + m.start()
            if m[0] != _GZIP:
                return place
            try:
                if zlib.decompressobj(31).decompress(source.get(place, 4096), 16).startswith(_VERSION):
                    return place
            except zlib.error:
                pass
        if at + len(chunk) >= source.size:
            return source.size
        at += len(chunk) - 16  # an overlap, for what a chunk's end cuts
    return source.size


def salvage(path: str, options: WarcOptions = WarcOptions()) -> Iterator[dict]:
    """Records of a file in order, and gaps: rows with a ``reason`` and the
    place and size of the bytes that no record accounts for."""
    source, at, gap, reason = _Window(path), 0, None, None
    while at < source.size:
        try:
            start = source.get(at, len(_VERSION))
            if start.startswith(_GZIP):
                record, size = _member(source, at, options.max_record)
            elif start == _VERSION:
                record, size = _plain(source, at, options.max_record)
            else:
                raise BadRecord("no record starts here")
            fields = _parse(record)
        except BadRecord as error:
            if gap is None:
                gap, reason = at, str(error)
            at = _next_start(source, at + 1)
            continue
        if gap is not None:
            yield {"path": path, "at": gap, "size": at - gap, "reason": reason}
            gap = None
        yield {"path": path, "at": at, "size": size, "reason": None} | fields
        at += size
    if gap is not None:
        yield {"path": path, "at": gap, "size": source.size - gap, "reason": reason}


def read_warc(files: DataFrame, options: WarcOptions = WarcOptions(), with_payload: bool = False) -> DataFrame:
    """Records and gaps (rows with a ``reason``) of the files in the column ``path``."""
    schema = _RECORD + ", payload binary" * with_payload
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for row in salvage(path, options):
                    rows.append({n: row.get(n) for n in arrow.names})
                    held += len(row.get("payload", b"")) * with_payload + 400
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    tasks = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.select("path").repartition(tasks, "path").mapInArrow(read, schema)


def gap_log(read: DataFrame) -> DataFrame:
    """The quarantined stretches: path, at, size and reason."""
    return read.where("reason is not null").select("path", "at", "size", "reason")


def warc_digests(pages: DataFrame, options: WarcOptions = WarcOptions()) -> DataFrame:
    """Writes the pages as archives, reads these back and returns their records."""
    return read_warc(write_warc(pages, options), options).where("reason is null").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
