"""Archives: a page comes back as it went in, however its payload looks."""

from __future__ import annotations

import hashlib

from tidemark import workspace as ws
from tidemark.llm import warc

B = "\r\n\r\n"


def brute(rows):
    first: dict[bytes, int] = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if page is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        origin = first.get(raw)
        again = origin is not None and page is not None and page > origin
        digest = hashlib.sha256(raw).hexdigest()
        out.append((page, len(raw), digest, "revisit" if again else "response", origin if again else None))
    return out


def test_round_trip(spark):
    nasty = ["", None, B, "a\r\n", "a\r\n\r", B * 50, "x" + B + "\r\n", "\r\n" * 7, "WARC/1.1\r\nA: b" + B, "é" * 70]
    long = ("word " * 200_000) + B + "tail\r\n"
    html = [*nasty, long, "y" * 100, "y" * 100, "y" * 99, "y" * 99, long]
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate(html)]
    rows += [(3, "http://again", html[3]), (None, None, "no id " * 30), (40, "two\r\nlines", "y" * 100), (12, "u", html[12])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS refers_to")
    read = warc.archive(pages, ws.fresh_folder(spark, "warc-test"))
    got = read.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows)))
    sizes = read.where("page_id = 10").orderBy("chunk_no").collect()
    assert len(sizes) == -(-len(long) // warc.CHUNK_BYTES) and sizes[-1].payload_bytes == len(long)
    assert [r.is_last for r in sizes] == [False] * (len(sizes) - 1) + [True]


def test_chunk_rows_carry_running_digests(spark):
    pages = spark.createDataFrame([(1, "abcdefg"), (2, None)], "page_id long, html string")
    rows = warc.chunks(pages, chunk_bytes=3).orderBy("page_id", "chunk_no").collect()
    assert [bytes(r["data"]) for r in rows] == [b"abc", b"def", b"g", b""]
    for r, n in zip(rows, (3, 6, 7, 0), strict=True):
        assert (r.payload_bytes, r.payload_digest) == (n, hashlib.sha256(b"abcdefg"[:n]).hexdigest())


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(pages, ws.fresh_folder(spark, "warc-test")).count() == 0
