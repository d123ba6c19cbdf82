"""WARC archives: exact round trip, broken archives."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard

import __spark_entry__ as entry
from perinuc.llm import warc

PAGES = [
    (1, "http://a/", "<html>one</html>"), (2, "http://b/", "<html>one</html>"), (3, None, None), (4, "http://c/\r\nX: y", ""),
    (5, "http://d/", "ü" * 300_000), (6, "http://e/", "line\r\n\r\nWARC/1.1\r\n"), (6, "http://e/", "line\r\n\r\nWARC/1.1\r\n"),
    (None, "http://f/", "<html>one</html>"), (None, "http://g/", "lost"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 1) for r in rows], "page_id long, url string, html string, digest string, payload string, n int")


def expected(rows):
    low = {}
    for i, _, html in rows:
        key = html or ""
        if i is not None:
            low[key] = min(i, low.get(key, i))
    out = []
    for i, _, html in rows:
        data, first = (html or "").encode(), low.get(html or "")
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = warc.round_trip(pages(spark, PAGES))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(PAGES)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_payloads_come_back_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    manifest = warc.write_warc(pages(spark, PAGES), folder)
    got = {r.page_id: r.payload for r in warc.read_warc(manifest, folder).collect() if r.record_type == "response"}
    assert got[5] == "ü".encode() * 300_000 and got[6] == b"line\r\n\r\nWARC/1.1\r\n" and got[3] == b""


def test_registered_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()
    got = entry.queries()["op2_warc_round_trip"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def records(n=400):
    text = [f"<html><body>page {k} of the archive, with shared words in it {k * k}</body></html>".encode() * 20 for k in range(n)]
    return [warc.record(k, f"http://x/{k}", t, warc.sha1_base32(t), None, False) for k, t in enumerate(text)]


def archive(recs):
    out = io.BytesIO()
    assert warc.write_archive(out, iter(recs)) == len(recs)
    return out.getvalue()


def test_dictionary_leads_and_every_record_is_a_frame():
    recs = records()
    data = archive(recs)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    assert list(warc.frames(io.BytesIO(data))) == recs
    # the frames need that dictionary
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data[8 + size :])))


def test_few_records_need_no_dictionary():
    recs = records(2)
    data = archive(recs)
    assert data[:4] == warc.FRAME and list(warc.frames(io.BytesIO(data))) == recs


def test_small_reads(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    recs = records(30)
    assert list(warc.frames(io.BytesIO(archive(recs)))) == recs


@pytest.mark.parametrize("cut", [3, 6, 100, -1, -40])
def test_cut_archives_are_refused(cut):
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.frames(io.BytesIO(archive(records())[:cut])))


@pytest.mark.parametrize(
    "old, new",
    [
        (b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dote"), (b"\r\nContent-Length: ", b"\r\nContent-Length: 1"),
        (b"page 3", b"page 4"), (b"WARC-Type: response", b"WARC-Type: conversion"), (b"<urn:x-page:3>", b"<urn:y-page:3>"),
        (b"HTTP/1.1 200", b"SPDY/1.1 200"),
    ],
)
def test_broken_records_are_refused(old, new):
    with pytest.raises(warc.WarcError):
        warc.parse(records(5)[3].replace(old, new, 1))
