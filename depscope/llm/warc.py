"""WARC archives compressed by record with a shared dictionary.

Every archive begins with a skippable frame that holds its dictionary, trained on the records of
that archive; each record is then one Zstandard frame. Archives are written by Spark's text writer,
so they reach any store Spark can write to and a lost task leaves nothing behind: a row is a frame,
and the separator between rows is an empty skippable frame, which decoders pass over.

An archive has a fixed number of rows, so the writer starts a new file just where the next
dictionary stands. One that is full by bytes before that is filled up with empty rows (8 bytes each).

Pages with equal payloads share one response, that with the smallest page; the others are revisits
without a payload. The first page per digest is a partial aggregate, and the join on the digest may
be split where a digest is hot.

Defined results: null html is an empty payload; a null page never is the first of several; rows that
repeat the first page are all responses; a null address is left out. Control characters in addresses
are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from depscope.scratch import new_folder

# Frame marks of Zstandard, and the frame type for dictionaries of archives.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS, ARCHIVE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 8 << 20, 64 << 10, 3
_WINDOW = 1 << 16


def _urn(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(urn: bytes) -> int | None:
    number = urn[len(b"<urn:page:") : -1]
    return None if number == b"none" else int(number)


def _clean(address: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in address)


def record_bytes(page: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool, date: str) -> tuple[bytes, bytes]:
    """(headers, block) of one record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _clean(url)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
        ("WARC-Refers-To", _urn(refers_to) if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode(), block


def build_dictionary(records: list[bytes], heads: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary trained on the records; few or tiny ones give their headers as they are."""
    try:
        # Segments of 1 KB compared by 8-byte pieces: fixed, so that no parameters are searched.
        return zstandard.train_dictionary(size, records, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(heads)[-size:]


def archive_frames(records: list[tuple[bytes, bytes]]) -> Iterator[bytes]:
    """The rows of one archive: the dictionary, then each record."""
    whole = [head + block + b"\r\n\r\n" for head, block in records]
    dictionary = build_dictionary(whole, [head for head, _ in records])
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
    for record in whole:
        yield compressor.compress(record)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of one archive, in order."""
    view, at, decompressor = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC:
                held = bytes(view[at + 8 : at + 8 + size])
                dictionary = zstandard.ZstdDecompressor().decompress(held) if held[:4] == ZSTD_MAGIC else held
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
            at += 8 + size
            continue
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + _WINDOW]
            if not piece:
                raise ValueError("an archive ends inside a record")
            out.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    """page, kind, refers_to, url, digest, payload_bytes and payload (None for revisits)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    http, _, payload = rest[: int(fields[b"Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    revisit = fields[b"WARC-Type"] == b"revisit"
    return {
        "page": _page(fields[b"WARC-Record-ID"]), "kind": fields[b"WARC-Type"].decode(),
        "refers_to": _page(fields[b"WARC-Refers-To"]) if revisit else None,
        "url": fields[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in fields else None,
        "digest": fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), "payload_bytes": size,
        "payload": None if revisit else payload,
    }


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page, url, payload, sha1, refers_to, revisit) from (page, url, payload as text)."""
    keyed = pages.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    first = keyed.groupBy("sha1", "size").agg(F.min("page").alias("first"))
    return keyed.join(first, ["sha1", "size"]).select(
        "page", "url", "payload", F.unhex("sha1").alias("sha1"), F.col("first").alias("refers_to"),
        F.coalesce(F.col("first").isNotNull() & (F.col("page").isNull() | (F.col("page") > F.col("first"))), F.lit(False)).alias("revisit"))


def write_archives(pages: DataFrame, folder: str, records: int = RECORDS, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write (page, url, payload, sha1, refers_to, revisit) as archives into a folder of any store."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def flush(full: bool) -> Iterator[pa.RecordBatch]:
            frames = list(archive_frames(held))
            fill = [b""] * (records + 1 - len(frames)) if full else []
            yield pa.RecordBatch.from_arrays([pa.array(frames + fill, pa.binary())], names=["frame"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page", "url", "payload", "sha1", "refers_to", "revisit")), strict=True):
                page, url, payload, sha1, refers_to, revisit = (x.as_py() for x in row)
                held.append(record_bytes(page, url, payload.encode(), sha1, refers_to, revisit, date))
                size += len(held[-1][0]) + len(held[-1][1])
                if len(held) == records or size >= archive_bytes:
                    yield from flush(True)
                    held.clear()
                    size = 0
        if held:
            yield from flush(False)

    frames = pages.mapInArrow(work, "frame binary").select(F.col("frame").cast("string"))
    frames.write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", records + 1).option("compression", "none").text(folder)


def read_archives(spark, folder: str) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to, intact) of all records below a folder.

    `intact` tells whether a response's payload has the digest and size its record states.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in read_archive(content.as_py()):
                    x = parse_record(record)
                    same = x["payload"] is None or (
                        len(x["payload"]) == x["payload_bytes"] and base64.b32encode(hashlib.sha1(x["payload"]).digest()).decode() == x["digest"])
                    rows.append((x["page"], x["payload_bytes"], x["digest"], x["kind"], x["refers_to"], same))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(work, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").cast("long").alias("page"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    folder = new_folder(spark, "archives")
    write_archives(with_revisits(pages), folder)
    return read_archives(spark, folder).withColumnRenamed("page", "page_id")


ORACLE = """
WITH pages_ AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages
), keyed AS (
  SELECT page_id, strlen(html) AS payload_bytes, digest, min(page_id) OVER (PARTITION BY html) AS first FROM pages_
), bits AS (
  SELECT *, CAST(CAST(unhex(digest) AS BIT) AS VARCHAR) AS bits FROM keyed
)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INTEGER)
    + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INTEGER)
    + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INTEGER), 1)), lambda a, b: a || b) AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to, true AS intact
FROM bits
"""
