"""WARC archives under Zstandard, one frame per record, with a dictionary in a leading skippable frame.

Tasks write archives straight into the shared folder and return a manifest; the reader opens only files of the manifest,
so a file left behind by a lost task is never read.  A payload that a smaller page id already carries is written as a
revisit: the HTTP header stays, the body does not.  The reader streams an archive frame by frame and checks the version
line, required headers, frame, block and payload lengths and both digests; a broken archive raises ``WarcError``.

Null payloads count as empty.  Pages without an id come last among copies; rows that repeat both id and payload are
written alike.  Line breaks and other control characters in addresses are percent-encoded, a null address is written as
``urn:x-page:unknown``.  An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perinuc.llm.common import joined_with_hot, own
from perinuc.scale import cut, shared_dir

# fixed values of the formats
SKIPPABLE_DICTIONARY = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Block-Digest", "WARC-Payload-Digest")

# payload bytes of one archive, and what its dictionary is fitted on
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 4 << 20
READ_BYTES = 1 << 18


class WarcError(ValueError):
    """An archive that does not keep to the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def urn_page(urn: str) -> int | None:
    if not (urn.startswith("<urn:x-page:") and urn.endswith(">")):
        raise WarcError(f"not a page: {urn[:80]}")
    name = urn[12:-1]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """One record; ``first`` is the page a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    address = "urn:x-page:unknown" if url is None else "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {address}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {page_urn(first)}", f"WARC-Profile: {PROFILE}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary fitted on the first records of an archive; none where they are too few to fit one."""
    sample, size = [], 0
    for r in records:
        sample.append(r[: 64 << 10])
        size += len(sample[-1])
        if size > SAMPLE_BYTES:
            break
    if len(sample) < 16 or size < 8 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8)
    except zstandard.ZstdError:
        return None


def write_archive(out: BinaryIO, records: Iterable[bytes]) -> int:
    """Write one archive, returning its number of records; the dictionary is fitted on what is held first."""
    records = iter(records)
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size > SAMPLE_BYTES:
            break
    fitted = _dictionary(first)
    if fitted is not None:
        packed = zstandard.ZstdCompressor(level=9, write_content_size=True).compress(fitted.as_bytes())
        out.write(struct.pack("<II", SKIPPABLE_DICTIONARY, len(packed)) + packed)
    squeeze = zstandard.ZstdCompressor(level=3, dict_data=fitted, write_checksum=True, write_content_size=True)
    n = 0
    for part in (first, records):
        for r in part:
            out.write(squeeze.compress(r))
            n += 1
    return n


class _Source:
    """Bytes of a stream, read in pieces, with what a decoder did not use put back."""

    def __init__(self, stream: BinaryIO):
        self.stream, self.held = stream, b""

    def piece(self) -> bytes:
        if self.held:
            out, self.held = self.held, b""
            return out
        return self.stream.read(READ_BYTES)

    def exactly(self, n: int) -> bytes:
        got = bytearray()
        while len(got) < n:
            piece = self.piece()
            if not piece:
                break
            got += piece
        self.held = bytes(got[n:]) + self.held
        return bytes(got[:n])


def frames(stream: BinaryIO) -> Iterator[bytes]:
    """The content of each frame of an archive, in order, under the dictionary of the leading skippable frame."""
    source, fitted, seen = _Source(stream), None, False
    while True:
        head = source.exactly(4)
        if not head:
            return
        if len(head) < 4:
            raise WarcError("archive ends inside a frame header")
        magic = struct.unpack("<I", head)[0]
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size_bytes = source.exactly(4)
            if len(size_bytes) < 4:
                raise WarcError("archive ends inside a skippable frame")
            size = struct.unpack("<I", size_bytes)[0]
            content = source.exactly(size)
            if len(content) < size:
                raise WarcError("archive ends inside a skippable frame")
            if magic == SKIPPABLE_DICTIONARY:
                if seen or fitted is not None:
                    raise WarcError("the dictionary must come first")
                if content[:4] == FRAME:  # a dictionary may be compressed itself
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                fitted = zstandard.ZstdCompressionDict(content)
            continue
        if head != FRAME:
            raise WarcError(f"not a Zstandard frame: {head.hex()}")
        seen, source.held = True, head + source.held
        decoder = zstandard.ZstdDecompressor(dict_data=fitted).decompressobj()
        out = io.BytesIO()
        while not decoder.eof:
            piece = source.piece()
            if not piece:
                raise WarcError("archive ends inside a frame")
            try:
                out.write(decoder.decompress(piece))
            except zstandard.ZstdError as e:
                raise WarcError(str(e)) from e
        source.held = decoder.unused_data + source.held
        yield out.getvalue()


def _headers(block: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = block.split(b"\r\n")
    found = {}
    for line in lines:
        name, colon, value = line.partition(b": ")
        if not colon or not name:
            raise WarcError(f"bad header line: {line[:80]!r}")
        found[name.decode()] = value.decode()
    return first, found


def _length(text: str | None) -> int:
    if text is None or not text.isascii() or not text.isdigit():
        raise WarcError(f"bad length: {text!r}")
    return int(text)


def parse(data: bytes) -> dict:
    """One record, checked: headers, payload, page_id, payload_bytes, payload_digest, record_type, refers_to."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("record without an end of its headers")
    version, headers = _headers(head)
    if version != VERSION:
        raise WarcError(f"unknown version: {version[:40]!r}")
    missing = [h for h in REQUIRED if h not in headers]
    if missing:
        raise WarcError(f"missing headers: {', '.join(missing)}")
    size = _length(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, header says {size}")
    block, kind = rest[:size], headers["WARC-Type"]
    if headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("block digest differs")
    if kind not in ("response", "revisit"):
        raise WarcError(f"unknown type: {kind}")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, http_headers = _headers(http)
    if not gap or not status.startswith(b"HTTP/1.1 "):
        raise WarcError("block without an HTTP header")
    length, digest = _length(http_headers.get("Content-Length")), headers["WARC-Payload-Digest"]
    refers = None
    if kind == "response":
        if len(payload) != length or digest != f"sha1:{sha1_base32(payload)}":
            raise WarcError("payload differs from its length or digest")
    else:
        if payload or headers.get("WARC-Profile") != PROFILE or "WARC-Refers-To" not in headers:
            raise WarcError("revisit with a body, or without what it refers to")
        refers = urn_page(headers["WARC-Refers-To"])
    return {
        "page_id": urn_page(headers["WARC-Record-ID"]),
        "url": headers.get("WARC-Target-URI"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": length,
        "payload_digest": digest.removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": refers,
    }


def write_warc(pages: DataFrame, folder: str, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Write ``pages`` below ``folder``; returns the manifest: path, records."""
    payload = F.coalesce(own(pages, html), F.lit("")).cast("binary")
    address = own(pages, url).cast("string") if url.lower() in {c.lower() for c in pages.columns} else F.lit(None).cast("string")
    rows = pages.select(
        own(pages, page_id).cast("long").alias("page_id"), address.alias("url"), payload.alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    # only payloads that several pages carry need a look-up
    shared = cut(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 1
    placed = joined_with_hot(rows, shared, "digest", "n", total).select("page_id", "url", "payload", "digest", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        rows = (r for b in batches for part in range(0, b.num_rows, 64) for r in b.slice(part, 64).to_pylist())
        held = next(rows, None)
        if held is not None:
            store.create_dir(root, recursive=True)

        def archive() -> Iterator[bytes]:
            nonlocal held
            size = 0
            while held is not None and size < ARCHIVE_BYTES:
                digest = base64.b32encode(held["digest"]).decode()
                revisit = held["first"] is not None and held["page_id"] != held["first"]
                yield record(held["page_id"], held["url"], held["payload"], digest, held["first"], revisit)
                size += len(held["payload"])
                held = next(rows, None)

        while held is not None:
            path = f"{root}/{uuid.uuid4()}.warc.zst"
            with store.open_output_stream(path, compression=None) as out:
                n = write_archive(out, archive())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return cut(placed.mapInArrow(write, "path string, records long"))


READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a manifest, one archive per task at a time, a few records in memory."""
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
         ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size, n = [], 0, 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        found = parse(data)
                        found["payload"] = found["payload"] if payloads else None
                        held.append(found)
                        size, n = size + len(data), n + 1
                        if size > SAMPLE_BYTES or len(held) >= 4096:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if n != said:
                    raise WarcError(f"{path} holds {n} records, the manifest says {said}")
                yield pa.RecordBatch.from_pylist(held, schema)

    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.count() // 4)
    return manifest.select("path", "records").repartition(max(1, tasks)).mapInArrow(read, READ_SCHEMA)


def round_trip(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back, without the payloads themselves."""
    base = shared_dir(pages.sparkSession)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    folder = f"{base.rstrip('/')}/warc-{uuid.uuid4()}"
    return read_warc(write_warc(pages, folder, html, page_id, url), folder, payloads=False).drop("payload", "url")
