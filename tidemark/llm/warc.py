"""WARC archives written and read as a table of payload chunks.

A payload is never one value: it is a run of rows (record, chunk number) of at most `CHUNK_BYTES`,
and each row carries the digest and length of everything up to and including itself, so the last
row of a record has those of the whole payload. In an archive a chunk is a WARC record of its own:
the first is `response`, later ones are `continuation` segments of it. Pages whose payload another
page already holds become `revisit` records without payload.

Archives are written with Spark's text writer: one row is one WARC record, and the row separator
is the blank line that ends a record. They are read with the same separator, file by file in
order, and a small state machine puts together what the separator has cut inside a payload.

Defined cases: a null payload is empty; a null or repeated page_id is kept, every row giving its
own record; a null url is left out of the headers; an empty table gives an empty archive; columns
other than the three named are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import settled

CHUNK_BYTES = 256 << 10
MIN_SHARED_BYTES = 100
BLANK = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = (
    "page_id long, record_type string, refers_to long, chunk_no int, is_last boolean, "
    "payload_bytes long, payload_digest string"
)


def _rows(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, memoryview]]:
    cells = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    for i in range(len(cells)):
        yield i, memoryview(cells[i].as_buffer()) if cells[i].is_valid else memoryview(b"")


def _pieces(payload: memoryview, size: int) -> Iterator[tuple[int, memoryview, bool]]:
    """Chunk number, bytes and whether it is the last; an empty payload is one empty chunk."""
    last = max(0, (len(payload) - 1) // size)
    for n in range(last + 1):
        yield n, payload[n * size : (n + 1) * size], n == last


def chunks(
    pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(page_id, chunk_no, data, is_last, payload_bytes, payload_digest); the last two run along."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, payload in _rows(batch, "payload"):
                digest, total = hashlib.sha256(), 0
                for n, piece, last in _pieces(payload, chunk_bytes):
                    digest.update(piece)
                    total += len(piece)
                    yield pa.record_batch(
                        [
                            pa.array([ids[i].as_py()], pa.int64()),
                            pa.array([n], pa.int32()),
                            pa.array([bytes(piece)], pa.binary()),
                            pa.array([last]),
                            pa.array([total], pa.int64()),
                            pa.array([digest.copy().hexdigest()]),
                        ],
                        ["page_id", "chunk_no", "data", "is_last", "payload_bytes", "payload_digest"],
                    )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(payload_col).alias("payload")).mapInArrow(
        cut,
        "page_id long, chunk_no int, data binary, is_last boolean, payload_bytes long, payload_digest string",
    )


def digests(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(page_id, payload_bytes, payload_digest) of whole payloads, fed chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for _, payload in _rows(batch, "payload"):
                digest = hashlib.sha256()
                for _, piece, _ in _pieces(payload, CHUNK_BYTES):
                    digest.update(piece)
                sizes.append(len(payload))
                found.append(digest.hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.string())],
                ["page_id", "payload_bytes", "payload_digest"],
            )

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(payload_col).alias("payload")).mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string"
    )


def revisits(digested: DataFrame, min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """(page_id, refers_to) of the pages whose payload a smaller page_id holds.

    The smallest id of a digest is found with map-side combining; a digest shared by very many
    pages meets its one row in a sort-merge join, whose large side Spark splits.
    """
    shared = digested.where(F.col("payload_bytes") >= min_bytes)
    first = (
        shared.groupBy("payload_digest")
        .agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"))
        .where("refers_to < _last")
        .drop("_last")
    )
    first = settled(first, "first-pages")
    return shared.join(first.hint("merge"), "payload_digest").where("page_id > refers_to").select("page_id", "refers_to")


def _name(page_id, n: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{n}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None)]
    return "\r\n".join(lines).encode() + BLANK


def records(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per WARC record, without the blank line at its end.

    `pages`: page_id, url, payload, refers_to (null: the page is a response).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, refers = (batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "refers_to"))
            out: list[bytes] = []
            held = 0
            for i, payload in _rows(batch, "payload"):
                page, url, origin = ids[i].as_py(), urls[i].as_py(), refers[i].as_py()
                url = None if url is None else " ".join(url.split())
                digest = hashlib.sha256()
                for _, piece, _ in _pieces(payload, chunk_bytes):
                    digest.update(piece)
                whole = [
                    ("WARC-Target-URI", url),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Payload-Digest", f"sha256:{digest.hexdigest()}"),
                    ("X-Page-ID", page),
                    ("X-Payload-Length", len(payload)),
                ]
                if origin is not None:
                    kind = [("WARC-Type", "revisit"), ("WARC-Record-ID", _name(page, 0)), ("WARC-Profile", PROFILE)]
                    refer = [("WARC-Refers-To", _name(origin, 0)), ("X-Refers-To-Page", origin)]
                    out.append(_head([*kind, *whole, *refer, ("Content-Length", 0)]))
                else:
                    for n, piece, last in _pieces(payload, chunk_bytes):
                        kind = [
                            ("WARC-Type", "continuation" if n else "response"),
                            ("WARC-Record-ID", _name(page, n)),
                            ("WARC-Segment-Number", None if last and not n else n + 1),
                            ("WARC-Segment-Origin-ID", _name(page, 0) if n else None),
                            ("WARC-Segment-Total-Length", len(payload) if last and n else None),
                        ]
                        out.append(_head([*kind, *whole, ("Content-Length", len(piece))]) + bytes(piece))
                        held += len(piece)
                        if held > 8 << 20:
                            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                            out, held = [], 0
            yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "value binary")


def write_archives(pages: DataFrame, path: str) -> None:
    """Compressed archives of the pages with their `refers_to`, one file per task."""
    records(pages).select(F.col("value").cast("string")).write.option("lineSep", BLANK.decode()).option(
        "compression", "gzip"
    ).text(path)


class Reader:
    """Fed with the bytes of archives in order; gives (headers, payload length, digest) at a record's end.

    Payload bytes go to the running digest of their page as they come and are not kept.
    """

    def __init__(self) -> None:
        self.head, self.left, self.tail, self.fields = b"", 0, 0, None
        self.digest, self.total = hashlib.sha256(), 0

    def feed(self, data: memoryview) -> Iterator[dict]:
        at = 0
        while at < len(data):
            if self.fields is None:
                if not self.head and data[at] in b"\r\n":  # left over where a file's last blank line was cut
                    at += 1
                    continue
                old = len(self.head)
                self.head += bytes(data[at : at + 4096])
                end = self.head.find(BLANK)
                if end < 0:
                    at += len(self.head) - old
                    continue
                at += end + 4 - old
                lines = self.head[:end].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"not the start of a WARC record: {lines[0][:40]!r}")
                self.fields, self.head = dict(x.split(": ", 1) for x in lines[1:]), b""
                self.left, self.tail = int(self.fields["Content-Length"]), 4
                if self.fields["WARC-Type"] != "continuation":
                    self.digest, self.total = hashlib.sha256(), 0
            take = min(self.left, len(data) - at)
            self.digest.update(data[at : at + take])
            self.total += take
            self.left -= take
            at += take
            if self.left == 0:
                skip = min(self.tail, len(data) - at)
                self.tail -= skip
                at += skip
                if self.tail == 0:
                    yield self.fields
                    self.fields = None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per stored chunk: its page, type and number, and length and digest up to its end.

    A revisit has no payload of its own; it reports the length and digest of the page it refers to.
    A stored payload that does not have the digest its record states is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            out = []
            for _, line in _rows(batch, "value"):
                for part in (line, memoryview(BLANK)):
                    for f in reader.feed(part):
                        again = f["WARC-Type"] == "revisit"
                        n = int(f.get("WARC-Segment-Number", 1)) - 1
                        size = int(f["X-Payload-Length"])
                        last = again or reader.total == size
                        stated = f["WARC-Payload-Digest"].removeprefix("sha256:")
                        found = stated if again else reader.digest.hexdigest()
                        if last and found != stated:
                            raise ValueError(f"payload digest of {f['WARC-Record-ID']} differs")
                        out.append(
                            {
                                "page_id": int(f["X-Page-ID"]) if "X-Page-ID" in f else None,
                                "record_type": "revisit" if again else "response",
                                "refers_to": int(f["X-Refers-To-Page"]) if again else None,
                                "chunk_no": n,
                                "is_last": last,
                                "payload_bytes": size if again else reader.total,
                                "payload_digest": found,
                            }
                        )
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    lines = spark.read.option("lineSep", BLANK.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, CHUNKS)


SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("chunk_no", pa.int32()),
        ("is_last", pa.bool_()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
    ]
)


def archive(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages (page_id, url, html) below `path` and return the chunk rows read back."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = settled(digests(pages), "page-digests")
    again = revisits(found).distinct()
    decided = pages.withColumnRenamed("html", "payload").join(again, "page_id", "left")
    write_archives(decided, path)
    return read_archives(spark, path)
