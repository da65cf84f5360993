"""Archives: round trips, ZIP64 and damage."""

import gzip
import hashlib
import io
import zipfile

import pytest

from jetforge.llm import warc, zipread

PAGES = [
    (1, "http://a/1", "x" * 1000), (3, "http://a/3", "x" * 1000), (2, "http://a/2", "x" * 1000), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, None, None), (7, "bad\r\nurl é", ""),
    (8, "u", "é" * 700), (9, "u", "é" * 700), (None, "u", "x" * 1000), (10, "u", "long " * 200_000), (3, "u", "x" * 1000), (None, "n", "n" * 2000), (None, "n", "n" * 2000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string")


def expected():
    last = {}
    for key, _, html in PAGES:
        data = (html or "").encode()
        if len(data) >= 1000 and key is not None:
            last[data] = max(key, last.get(data, key))
    for key, _, html in PAGES:
        data = (html or "").encode()
        refers = last.get(data) if last.get(data) != key else None
        yield str(key), len(data), hashlib.sha1(data).hexdigest(), "response" if refers is None else "revisit", str(refers)


def rows(frame):
    return sorted((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in frame.collect())


@pytest.mark.parametrize("archive_bytes", [1, warc.ARCHIVE_BYTES])
def test_round_trip(pages, archive_bytes, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 5000)
    archives = warc.write_archives(pages.repartition(3), archive_bytes=archive_bytes)
    assert rows(warc.read_archives(archives)) == sorted(expected())
    got = {r.key: bytes(r.payload).decode() for r in warc.read_archives(archives, with_payload=True).collect() if r.record_type == "response" and r.key}
    assert got == {str(k): h or "" for k, _, h in PAGES if k in (3, 4, 5, 6, 7, 9, 10)}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_shared_payloads_by_join(pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert rows(warc.read_archives(warc.write_archives(pages))) == sorted(expected())


def test_directory_agrees_with_zipfile(pages):
    uri = warc.write_archives(pages.coalesce(1)).first().archive
    with zipread.open_file(uri) as f:
        mine = {m.name: (m.size, f.read_at(40, zipread.data_start(f, m))) for m in zipread.members(f)}
    with zipfile.ZipFile(zipread.file_system(uri)[1]) as z:
        assert mine == {i.filename: (i.file_size, z.read(i)[:40]) for i in z.infolist()}


def test_zip64_and_comment(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 5)
    monkeypatch.setattr(zipread, "CHUNK", 64)
    path, data = tmp_path / "big.zip", {f"archive/{i}": bytes([i]) * (150 * i + 1) for i in range(12)}
    with zipfile.ZipFile(path, "w", allowZip64=True) as z:
        for name, body in data.items():
            z.writestr(name, body)
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    with zipread.open_file(str(path)) as f:
        got = {m.name: f.read_at(m.size, zipread.data_start(f, m)) for m in zipread.members(f)}
    assert got == data


def test_without_index_and_damage(tmp_path, spark):
    body = b"".join(warc._gzip(warc.record(str(i), f"u{i}", b"payload %d" % i, None)) for i in range(5))
    path = tmp_path / "plain.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/other.warc.gz", body)
    frame = spark.createDataFrame([(str(path),)], "archive string")
    assert sorted(r.key for r in warc.read_archives(frame).collect()) == list("01234")
    (tmp_path / "cut.zip").write_bytes(path.read_bytes()[:-10])
    with zipread.open_file(str(tmp_path / "cut.zip")) as f, pytest.raises(ValueError, match="central directory"):
        list(zipread.members(f))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x.warc.gz", b"a" * 5000)
    (tmp_path / "packed.zip").write_bytes(packed.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        list(warc.entries(str(tmp_path / "packed.zip")))
    record = warc.record("1", "u", b"payload", None).replace(b"payload", b"paXload")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(record)


def test_index_without_a_last_line_feed_and_members_without_an_index(tmp_path):
    records = [gzip.compress(b"record %d" % i) for i in range(5)]
    line = lambda i, at: b'k 2 {"filename": "a.warc.gz", "offset": "%d", "length": "%d"}' % (at, len(records[i]))
    path = tmp_path / "foreign.wacz"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/a.warc.gz", records[0] + records[1])
        z.writestr("archive/b.warc.gz", b"".join(records[2:]))
        z.writestr("indexes/index.cdxj", line(0, 0) + b"\n" + line(1, len(records[0])))
    data = path.read_bytes()
    assert [gzip.decompress(data[at:at + n]) for at, n in warc.entries(str(path))] == [b"record %d" % i for i in range(5)]
