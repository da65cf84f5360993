"""The secret scan: time on hard texts, nesting, and base spans of a whole table by another scanner."""

import base64
import gzip
import hashlib
import time
import zlib

import pytest

from jetforge.llm import secrets

HARD = {
    "gzip headers without an end": lambda n: "%1f%8b%08" * (n // 9),
    "gzip headers with one end": lambda n: "%1f%8b%08" * (n // 9) + "%00",
    "nested percent signs": lambda n: "%" + "25" * (n // 2) + "41",
    "nested backslashes": lambda n: "\\" + "x5c" * (n // 3) + "x41",
    "nested references": lambda n: "&" + "#38;" * (n // 4) + "#65;",
    "base64 of headers": lambda n: "H4sI" * (n // 4),
    "zlib starts in zlib data": lambda n: "%78%9c" + "%78%9cAAAA" * (n // 10),
    "stored blocks": lambda n: base64.b64encode(b"x\x9c\x00\x05\x00\xfa\xff" * (n // 10)).decode(),
}


@pytest.mark.parametrize("name", sorted(HARD))
def test_time_follows_length(name):
    def seconds(n):
        start = time.perf_counter()
        secrets.find(HARD[name](n))
        return time.perf_counter() - start

    small, large = seconds(100_000), seconds(1_000_000)
    assert large < 60 and large < 40 * small + 2


def test_deep_nesting_is_unwrapped_to_the_end():
    text = "password=hunter2hunter2"
    for _ in range(30):
        text = text.replace("%", "%25").replace("=", "%3D")
    assert "=" not in text
    _, spans = secrets.find(f"see {text} end")
    assert ("assign", 4, 4 + len(text)) in spans
    accent = "pass" + "%2525252525252525C3%25252525252525A9" + " token%25252525252525253Dabcdef123"
    assert ("assign", accent.index("token"), len(accent)) in secrets.find(accent)[1]
    mixed = "token" + "%5cx255cx255c".replace("%5cx255cx255c", "\\x25" + "25" * 8 + "5cu003d") + "abcdef123"
    assert ("assign", 0, len(mixed)) in secrets.find(mixed)[1]


def test_streams_behind_false_starts():
    packed = zlib.compress(b"secret=abcdefgh12345678")
    data = b"\x1f\x8b\x08\x1f" * 50 + b"x\x9cK" * 30 + packed
    text = "".join(f"%{c:02x}" for c in data)
    assert any(kind == "assign" for kind, _, _ in secrets.find(text)[1])
    named = gzip.compress(b"secret=abcdefgh12345678")
    named = named[:3] + b"\x08" + named[4:10] + b"file.txt\0" + named[10:]
    assert any(kind == "assign" for kind, _, _ in secrets.find(base64.b64encode(named).decode())[1])


WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
VALUE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def run(text, at, allowed):
    while at < len(text) and text[at] in allowed:
        at += 1
    return at


def base_by_hand(text):
    """Character by character, without regular expressions."""
    found, at = [], 0
    low = "".join(c.lower() if c.isascii() else c for c in text)
    while at < len(text):
        word = next((w for w in WORDS if low.startswith(w, at)), None)
        end = None
        if word:
            p = at + len(word)
            p += text[p:p + 1] in ('"', "'") and text[p:p + 1] != ""
            p = run(text, p, " ")
            if text[p:p + 1] in (":", "=") and p < len(text):
                p = run(text, p + 1, " ")
                p += text[p:p + 1] in ('"', "'") and text[p:p + 1] != ""
                end = run(text, p, VALUE)
                if end > p:
                    if end - p >= 6:
                        found.append(("assign", at, end))
                else:
                    end = None
        at = end if end else at + 1
    for kind, first, allowed, least in (("access", "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20), ("hex", "", "0123456789abcdef", 24)):
        at = 0
        while at < len(text):
            end = run(text, at + len(first), allowed) if text.startswith(first, at) else at
            if end > at + len(first):
                if end - at >= least:
                    found.append((kind, at, end))
                at = end
            else:
                at += 1
    return found


def test_base_spans_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and sum(r.n_assign + r.n_access + r.n_hex for r in got.values()) > 0
    for r in rows:
        base = base_by_hand(r.text or "")
        listed = secrets.joined(base)
        row = got[r.doc_id]
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == kind for k, _, _ in base) for kind in secrets.KINDS]
        assert row.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row.spans.split(","))


def chained(n, inner=b""):
    """n zlib starts in a chain of stored blocks without an end: each one inflates to the end of it."""
    block = lambda payload: b"\0" + len(payload).to_bytes(2, "little") + (65535 - len(payload)).to_bytes(2, "little") + payload
    return b"x\x9c" + block(b"x\x9c") * n + block(inner or b"  ") + block(b"rest")


@pytest.mark.parametrize("n", [10, 700, 1500])
@pytest.mark.parametrize("form", ["base64", "url"])
def test_streams_behind_any_number_of_false_starts(n, form):
    data = chained(n, zlib.compress(b"secret=abcdefgh12345678"))
    text = base64.b64encode(data).decode() if form == "base64" else "".join(f"%{c:02x}" for c in data)
    _, spans = secrets.find(f"see {text}")
    assert any(kind == "assign" and start > len(text) // 2 and end < 4 + len(text) for kind, start, end in spans)


def test_starts_of_one_stretch_share_its_bytes():
    import tracemalloc

    text = base64.b64encode(chained(3000)).decode()  # 3,000 starts of 10 kB on average: 32 MB if each had its own
    tracemalloc.start()
    secrets.find(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
