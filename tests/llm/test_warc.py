import gzip
import hashlib
import tempfile
from pathlib import Path

import pytest

from vectorloom.llm.warc import VERSION, read_archives, segments, write_archives

MARK = f"{VERSION}\r\n"
ROWS = [
    (1, "http://a/é x\r\n", "é" * 900), (2, None, "é" * 900), (3, "u", None), (4, "u", ""), (5, "u", MARK * 40 + "\r\n\r\n" + MARK),
    (6, "u", "x" * 5000 + VERSION), (None, "u", "z" * 2000), (8, "u", "z" * 2000), (8, "u", "z" * 2000), (None, None, "q" * 1500),
    (9, "u", "\r\n\r\n" * 300), (10, "u", "é中😀" * 1000), (11, "u", "é中😀" * 1000), (12, "u", "s"), (13, "u", "s"),
]


def expected(rows):
    best = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 1000:
            best[html] = max(best.get(html, page), page)
    result = []
    for page, _, html in rows:
        data = (html or "").encode()
        refers = best.get(html) if best.get(html) != page else None
        result.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(result, key=repr)


def round_trip(spark, rows, size):
    pages = spark.createDataFrame([(p, u, h, "x") for p, u, h in rows], "page_id long, url string, html string, label string")
    path = tempfile.mkdtemp() + "/archives"
    write_archives(pages, path, segment_bytes=size)
    return path, sorted(map(tuple, read_archives(spark, path).collect()), key=repr)


def test_round_trip_at_every_chunk_size(spark):
    for size in (64, 1000, 1 << 20):
        assert round_trip(spark, ROWS, size)[1] == expected(ROWS)
    assert round_trip(spark, [], 64)[1] == []


def test_archives_are_sequences_of_records(spark):
    path, _ = round_trip(spark, ROWS, 64)
    names = set()
    for file in Path(path).glob("*.gz"):
        data = gzip.open(file).read()
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at) + 4
            first, *lines = data[at : end - 4].decode().split("\r\n")
            fields = dict(line.split(": ", 1) for line in lines)
            assert first == VERSION and fields["WARC-Record-ID"].startswith("<urn:uuid:")
            names.add(fields["WARC-Type"])
            at = end + int(fields["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
    assert names == {"response", "revisit", "continuation"}


def test_chunks_hold_no_marker_and_whole_characters():
    payload = ("é" * 333 + MARK + "😀" * 50 + VERSION).encode()
    parts = list(segments(payload, 50))
    assert b"".join(parts) == payload and max(map(len, parts)) <= 50
    assert all(VERSION.encode() not in p and p.decode() is not None for p in parts) and list(segments(b"")) == [b""]


def test_foreign_records_and_lost_responses_stop_the_job(spark):
    path = tempfile.mkdtemp()
    record = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    Path(path, "a.warc").write_bytes(record.encode())
    with pytest.raises(Exception, match="was not written by write_archives"):
        read_archives(spark, path).collect()
    pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "u", "x" * 2000)], "page_id long, url string, html string")
    whole, part = tempfile.mkdtemp() + "/archives", tempfile.mkdtemp()
    write_archives(pages.repartitionByRange(2, "page_id"), whole)
    for file in Path(whole).glob("*.gz"):
        data = gzip.open(file).read()
        records = [VERSION.encode() + r for r in data.split(VERSION.encode()) if b"WARC-Type: revisit" in r]
        Path(part, f"{file.stem}.warc").write_bytes(b"".join(records))
    with pytest.raises(Exception, match="no response for the revisit of page 1"):
        read_archives(spark, part).collect()


def test_an_oversized_page(spark):
    rows = [(1, "u", "<p>long</p>" * 700_000), (2, "u", "short")]
    assert round_trip(spark, rows, 1 << 20)[1] == expected(rows)
