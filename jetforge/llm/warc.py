"""WARC records in ZIP-packaged archives.

An archive is a ZIP file with stored members: ``archive/*.warc.gz`` (one gzip member per record)
and ``indexes/*.cdxj`` (where each record lies). Reading finds the members through the central
directory and fetches records by range, without unpacking anything.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, shared_path, stored
from .zipread import data_start, file_system, members, open_file

ARCHIVE_BYTES = 256 << 20  # a task starts another archive beyond
LEVEL = 3
MIN_SHARED = 1000  # bytes of a payload from which equal ones are written once
BROADCAST_ROWS = 500_000
RANGE_BYTES = 8 << 20  # records of such a stretch are read by one task together
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def _head(lines: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode("utf-8")


def record(key: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit of the record of ``refers_to``: its HTTP headers alone."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _head(lines) + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Archive:
    """One ZIP file being written, record by record, to wherever the folder is."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        fs, path = file_system(self.uri)
        fs.create_dir(posixpath.dirname(path), recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, key: str | None, packed: bytes) -> None:
        self.data.write(packed)
        self.lines.append(json.dumps({"key": key, "filename": posixpath.basename(DATA), "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in self.lines))
        self.zip.close()
        self.out.close()
        return self.uri, len(self.lines), self.size


def _writer(folder: str, archive_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for key, url, payload, refers in zip(*(batch.column(i) for i in range(4))):
                if archive is not None and archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
                archive = archive or _Archive(folder)
                archive.add(key.as_py(), _gzip(record(key.as_py(), url.as_py(), payload.as_py() or b"", refers.as_py())))
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())],
            names=["archive", "records", "bytes"])
    return write


def write_archives(pages: DataFrame, folder: str | None = None, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_shared: int = MIN_SHARED, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row; returns the archives: ``archive`` (its address), records and bytes.

    Of rows with equal payloads of at least ``min_shared`` bytes the one with the largest key is a
    response, the others revisit it; rows that share the largest key are all responses, and so are
    rows of a group without any key. A null payload is empty. Only digests are grouped; payloads
    move only if the groups outgrow a broadcast.

    Tasks write under names of their own attempt, and the list of archives is itself a written
    table: what a lost or repeated attempt leaves behind is in no list.
    """
    folder = folder or shared_path(pages.sparkSession, "archives")
    payload = F.encode(F.coalesce(quoted(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(quoted(key_col).alias("key"), quoted(url_col).cast("string").alias("url"), payload.alias("payload"))
    shared = (
        rows.select("key", F.sha1("payload").alias("digest"), F.length("payload").alias("n")).where(F.col("n") >= min_shared)
        .groupBy("digest", "n").agg(F.count(F.lit(1)).alias("rows"), F.max("key").alias("last")).where("rows > 1 and last is not null")
    )
    shared = stored(shared.select("digest", "last"), "shared-payloads")
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    digest = F.when(F.length("payload") >= min_shared, F.sha1("payload"))
    marked = rows.withColumn("own", digest).join(shared, F.col("own") == F.col("digest"), "left")
    refers = F.when(~F.col("key").eqNullSafe(F.col("last")), F.col("last"))
    out = marked.select(F.col("key").cast("string").alias("key"), "url", "payload", refers.cast("string").alias("refers_to"))
    return stored(out.mapInArrow(_writer(folder, archive_bytes), "archive string, records long, bytes long"), "archive-list")


def _gzip_members(f: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member of a stretch, for archives without an index."""
    at, end = start, start + size
    while at < end:
        z, pos = zlib.decompressobj(31), at
        while not z.eof:
            data = f.read_at(min(1 << 20, end - pos), pos)
            if not data:
                raise ValueError("archive member is cut off")
            z.decompress(data)
            pos += len(data)
        pos -= len(z.unused_data)
        yield at, pos - at
        at = pos


def entries(uri: str) -> Iterator[tuple[int, int]]:
    """Absolute offset and length of every record of an archive, by its indexes; WARC members that
    no index names are walked."""
    with open_file(uri) as f:
        found = list(members(f))
        data = {posixpath.basename(m.name): m for m in found if re.search(r"\.warc(\.gz)?$", m.name)}
        indexes = [m for m in found if m.name.startswith("indexes/") and m.name.endswith(".cdxj")]
        starts, named = {n: data_start(f, m) for n, m in data.items()}, set()
        for m in indexes:
            at, left, rest = data_start(f, m), m.size, b""
            while left:
                piece = f.read_at(min(left, 1 << 20), at)
                at, left = at + len(piece), left - len(piece)
                lines = (rest + piece).split(b"\n")
                rest = lines.pop()
                if not left:
                    lines.append(rest)  # the last line may have no line feed
                for line in lines:
                    if line.strip():
                        x = json.loads(line[line.index(b"{"):])
                        named.add(x["filename"])
                        yield starts[x["filename"]] + int(x["offset"]), int(x["length"])
        for n, m in data.items():
            if n not in named:
                yield from _gzip_members(f, starts[n], m.size)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            part: list[tuple[int, int]] = []
            for x in entries(uri):
                part.append(x)
                if len(part) == 50_000:
                    yield _located(uri, part)
                    part = []
            yield _located(uri, part)


def _located(uri: str, part: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([uri] * len(part), pa.string()), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())],
        names=["archive", "offset", "length"])


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _urn(value: str | None) -> str | None:
    return (value or "")[len("<urn:page:"):-1] or None


def parse(data: bytes) -> dict:
    """Fields of one record. A response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(warc["warc-payload-digest"].split(":", 1)[1]).hex()
    if warc["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != said:
        raise ValueError(f"{warc['warc-record-id']}: payload does not have the digest of its header")
    revisit = warc["warc-type"] == "revisit"
    return {"key": _urn(warc["warc-record-id"]), "url": warc["warc-target-uri"], "record_type": warc["warc-type"],
            "payload_bytes": int(_fields(b"\r\n" + http)["content-length"]) if revisit else len(payload), "payload_digest": said,
            "refers_to": _urn(warc.get("warc-refers-to")), "payload": None if revisit else payload}


RECORD = pa.schema([("key", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _records(with_payload: bool):
    schema = RECORD if with_payload else pa.schema(list(RECORD)[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, f = None, None
        for batch in batches:
            rows, held = [], 0
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns[:3])):
                if name != uri:
                    if f is not None:
                        f.close()
                    uri, f = name, open_file(name)
                got = parse(zlib.decompress(f.read_at(length, offset), 31))
                rows.append({k: got[k] for k in schema.names})
                held += len(got["payload"] or b"") if with_payload else 0
                if held >= RANGE_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if f is not None:
            f.close()
    return read


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the archives of an ``archive`` column: key, url, record_type, payload_bytes,
    payload_digest (hex SHA-1 of the full payload), refers_to, and on request the payload (null for
    a revisit).

    One task lists an archive's records from its index; the ranges are then dealt out, so that
    neighbours of one stretch are read by one task, in order, and a large archive by many.
    """
    listed = archives.select("archive").mapInArrow(_entries, "archive string, offset long, length long")
    dealt = listed.withColumn("stretch", F.floor(F.col("offset") / RANGE_BYTES)).repartition("archive", "stretch").sortWithinPartitions("archive", "offset")
    fields = "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * with_payload
    return dealt.mapInArrow(_records(with_payload), fields)
