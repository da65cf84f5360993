"""Members of ZIP archives by range reads: central directory, ZIP64 included."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs

# Signatures and fixed-length parts of the format.
END, END_LENGTH = b"PK\x05\x06", 22
END64_LOCATOR, END64_LOCATOR_LENGTH = b"PK\x06\x07", 20
END64, END64_LENGTH = b"PK\x06\x06", 56
ENTRY, ENTRY_LENGTH = b"PK\x01\x02", 46
LOCAL, LOCAL_LENGTH = b"PK\x03\x04", 30
EXTRA64 = 1
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
MAX_COMMENT = 0xFFFF
CHUNK = 1 << 20

STORED = 0


class Member(NamedTuple):
    name: str
    method: int
    compressed: int
    size: int
    header: int  # offset of the local header


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def open_file(uri: str) -> pa.NativeFile:
    fs, path = file_system(uri)
    return fs.open_input_file(path)


def directory(f: pa.NativeFile) -> tuple[int, int]:
    """Offset and number of entries of the central directory."""
    size = f.size()
    start = max(0, size - END_LENGTH - MAX_COMMENT)
    tail = f.read_at(size - start, start)
    at = tail.rfind(END)
    while at >= 0 and (at + END_LENGTH > len(tail) or at + END_LENGTH + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive, or cut off")
    entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
    where = start + at - END64_LOCATOR_LENGTH
    if entries == FULL16 or FULL32 in (length, offset):
        locator = f.read_at(END64_LOCATOR_LENGTH, where)
        if locator[:4] != END64_LOCATOR:
            raise ValueError("ZIP64 locator missing")
        end64 = f.read_at(END64_LENGTH, struct.unpack_from("<Q", locator, 8)[0])
        if end64[:4] != END64:
            raise ValueError("ZIP64 end of central directory missing")
        entries, length, offset = struct.unpack_from("<QQQ", end64, 32)
    return offset, entries


def members(f: pa.NativeFile) -> Iterator[Member]:
    """Entries of the central directory, read in pieces of CHUNK."""
    at, entries = directory(f)
    held, base = b"", at

    def need(pos: int, n: int) -> bytes:
        nonlocal held, base
        if pos < base or pos + n > base + len(held):
            held, base = f.read_at(max(n, CHUNK), pos), pos
        return held[pos - base:pos - base + n]

    for _ in range(entries):
        fixed = need(at, ENTRY_LENGTH)
        if fixed[:4] != ENTRY:
            raise ValueError("damaged central directory")
        method, compressed, size, name_n, extra_n, comment_n = struct.unpack_from("<H8xIIHHH", fixed, 10)
        header = struct.unpack_from("<I", fixed, 42)[0]
        rest = need(at + ENTRY_LENGTH, name_n + extra_n)
        extra, pos = rest[name_n:], 0
        while pos + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, pos)
            if tag == EXTRA64:
                # Only the values that are full in the entry stand here, in this order.
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, pos + 4))
                size = next(wide) if size == FULL32 else size
                compressed = next(wide) if compressed == FULL32 else compressed
                header = next(wide) if header == FULL32 else header
            pos += 4 + n
        yield Member(rest[:name_n].decode("utf-8", "replace"), method, compressed, size, header)
        at += ENTRY_LENGTH + name_n + extra_n + comment_n


def data_start(f: pa.NativeFile, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    local = f.read_at(LOCAL_LENGTH, member.header)
    if local[:4] != LOCAL:
        raise ValueError(f"{member.name}: damaged local header")
    name_n, extra_n = struct.unpack_from("<HH", local, 26)
    return member.header + LOCAL_LENGTH + name_n + extra_n
