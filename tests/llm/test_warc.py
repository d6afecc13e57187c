"""Archives: written, read back, and read by the plain library."""

import base64
import glob
import hashlib

import zstandard

from depscope.llm import warc

SCHEMA = "page long, url string, payload string, revisit string"


def _write(spark, folder, rows, **sizes):
    pages = spark.createDataFrame(rows, SCHEMA).select("page", "url", "payload")
    warc.write_archives(warc.with_revisits(pages), folder, **sizes)
    return sorted(map(tuple, warc.read_archives(spark, folder).collect()), key=str)


def test_round_trip_with_revisits(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "<p>" + "word " * (i % 7) + "</p>", "x") for i in range(200)] + [(500, None, "", "x"), (501, "http://x/a\nb c", "", "x"), (None, "u", "lone", "x")]
    got = _write(spark, str(tmp_path / "a"), rows, records=20)
    first = {}
    for page, _, payload, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(payload, page)
    expected = []
    for page, _, payload, _ in rows:
        again = page is not None and page != first[payload]
        digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        expected.append((page, len(payload.encode()), digest, "revisit" if again else "response", first[payload] if again else None, True))
    assert got == sorted(expected, key=str)


def test_archives_hold_a_dictionary_and_a_frame_per_record(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<html><body>page {i} " + "common markup of all pages " * 20 + "</body></html>", "x") for i in range(300)]
    folder = str(tmp_path / "b")
    _write(spark, folder, rows, records=50)
    files = glob.glob(folder + "/part-*")
    assert len(files) >= 6
    for name in files:
        with open(name, "rb") as file:
            data = file.read()
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        records = list(warc.read_archive(data))
        assert 0 < len(records) <= 50 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        assert dictionary[:4] == b"\x37\xa4\x30\xec" or len(records) < 10
        assert len(data) < sum(map(len, records)) / 3


def test_full_by_bytes_starts_the_next_archive(spark, tmp_path):
    rows = [(i, "u", "x" * 4000 + str(i), "x") for i in range(100)]
    folder = str(tmp_path / "c")
    assert len(_write(spark, folder, rows, records=40, archive_bytes=20_000)) == 100
    for name in glob.glob(folder + "/part-*"):
        with open(name, "rb") as file:
            assert len(list(warc.read_archive(file.read()))) <= 5


def test_repeated_rows_and_empty_table(spark, tmp_path):
    got = _write(spark, str(tmp_path / "d"), [(1, "u", "same", "x"), (1, "u", "same", "x"), (2, "u", "same", "x")])
    assert [(r[0], r[3], r[4]) for r in got] == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert warc.with_revisits(spark.createDataFrame([], "page long, url string, payload string")).count() == 0


def test_long_payloads_and_header_lines_inside(spark, tmp_path):
    rows = [(1, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 3, "x"), (2, "u", "é" * 3_000_000, "x")]
    got = _write(spark, str(tmp_path / "e"), rows)
    assert [(r[0], r[1], r[5]) for r in got] == [(1, 99, True), (2, 6_000_000, True)]
