"""WARC archives as seekable Zstandard bundles.

Records are written in groups; each group is an independent Zstandard frame. Two skippable frames
end a bundle: an index, which maps record identifiers to (frame, offset in the frame, length), and a
seek table in the seekable Zstandard layout, which gives the sizes of all frames before it. A
plain Zstandard reader sees nothing but the records; ``fetch`` reads one record by inflating one
frame. Bundles are rows of a binary column, so any store that Spark writes to can hold them.

Of the records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest
page_id is a response, the others are revisit records that name it.

Defined results: null html is an empty payload; a null url gives no target URI, and control
characters in one are percent-encoded; if a payload's smallest page_id occurs on several rows, all of these are responses; a
null page_id is never the smallest, and rows whose payload has null page_ids only are responses;
a very long payload is a record and a frame of its own; of equal payloads the smallest page_id decides, so ties do
not occur; an empty table gives no bundle and no row; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.session import materialize, small_batches, splittable, table

#: Fixed values of the formats.
SEEK_MAGIC, SEEK_FOOTER, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT = 100
FRAME_BYTES = 1 << 18  # of records, before compression; a longer record is a frame of its own
BUNDLE_BYTES = 1 << 22  # of compressed frames
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}>"


def write_record(page_id: int | None, url: str | None, payload: bytes | None, n: int, digest: str, refers_to: int | None, date: str = DATE) -> tuple[str, bytes]:
    """Identifier and bytes of a record; a revisit has no payload but keeps its length and digest."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    body = http + (payload or b"")
    own = record_id(page_id, digest)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body))), ("X-Payload-Length", str(n))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    text = "".join(f"{k}: {v}\r\n" for k, v in head)
    return own, b"WARC/1.1\r\n" + text.encode() + b"\r\n" + body + b"\r\n\r\n"


def read_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the place after the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) for line in lines)
    body = data[end + 4 : end + 4 + int(head["Content-Length"])]
    after = end + 4 + len(body)
    if data[after : after + 4] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    return head, body[body.index(b"\r\n\r\n") + 4 :], after + 4


class BundleWriter:
    """Collects records and gives bundles of bounded size."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self._clear()

    def _clear(self) -> None:
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open, self.size, self.packed = [], 0, 0

    def add(self, name: str, record: bytes) -> None:
        if self.size and self.size + len(record) > FRAME_BYTES:
            self._frame()
        self.index.append((name, len(self.frames), self.size, len(record)))
        self.open.append(record)
        self.size += len(record)

    def _frame(self) -> None:
        self.frames.append((self.compressor.compress(b"".join(self.open)), self.size))
        self.packed += len(self.frames[-1][0])
        self.open, self.size = [], 0

    def full(self) -> bool:
        return self.packed >= BUNDLE_BYTES

    def finish(self) -> tuple[bytes, int]:
        """The bundle and its number of records."""
        if self.size:
            self._frame()
        index = zstandard.ZstdCompressor().compress(json.dumps(self.index).encode())
        frames = [*self.frames, (struct.pack("<II", INDEX_MAGIC, len(index)) + index, 0)]
        entries = b"".join(struct.pack("<II", len(x), n) for x, n in frames)
        footer = struct.pack("<IBI", len(frames), 0, SEEK_FOOTER)
        out = b"".join(x for x, _ in frames) + struct.pack("<II", SEEK_MAGIC, len(entries) + len(footer)) + entries + footer
        n = len(self.index)
        self._clear()
        return out, n


class Bundle:
    """Random access to a bundle."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_FOOTER or flags & 0x7C:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        start = len(data) - 9 - n * width
        if struct.unpack_from("<II", data, start - 8) != (SEEK_MAGIC, n * width + 9):
            raise ValueError("bad seek table")
        self.data, self.places, at = data, [], 0
        for i in range(n):
            packed, size = struct.unpack_from("<II", data, start + i * width)
            self.places.append((at, packed, size))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, size = self.places[i]
        return self.unpack.decompress(self.data[at : at + packed], max_output_size=size) if size else b""

    def index(self) -> dict[str, tuple[int, int, int]]:
        at, packed, _ = self.places[-1]
        if struct.unpack_from("<I", self.data, at)[0] != INDEX_MAGIC:
            raise ValueError("no index")
        return {name: (i, start, n) for name, i, start, n in json.loads(self.unpack.decompress(self.data[at + 8 : at + packed]))}

    def fetch(self, name: str) -> tuple[dict[str, str], bytes]:
        """Headers and payload of one record; only its frame is inflated."""
        i, at, n = self.index()[name]
        return read_record(self.frame(i)[at : at + n])[:2]

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for i in range(len(self.places)):
            data, at = self.frame(i), 0
            while at < len(data):
                head, payload, at = read_record(data, at)
                yield head, payload


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, n, digest, refers_to and payload (null for revisits).

    Digests are pre-aggregated before the shuffle and only those of several rows are joined, so a
    payload that fills a third of the table costs one row a task on that side; on the other side
    the skew-join rule splits it.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"))
    first = rows.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("times"))
    out = rows.join(splittable(first.where("times > 1 and first is not null").drop("times"), "digest"), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.col("first"))
    out = out.withColumn("refers_to", refers)
    return out.select("page_id", "url", "n", "digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))


def write_bundles(marked: DataFrame) -> DataFrame:
    """(bundle string, n_records long, data binary) from mark_revisits()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = BundleWriter()

        def bundle() -> pa.RecordBatch:
            data, n = w.finish()
            return pa.RecordBatch.from_pydict({"bundle": [hashlib.sha256(data).hexdigest()], "n_records": [n], "data": [data]})

        for b in batches:
            for page, url, n, digest, refers, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w.add(*write_record(page, url, payload.encode() if refers is None else None, n, digest, refers))
                if w.full():
                    yield bundle()
        if w.index:
            yield bundle()

    small_batches(marked.sparkSession)
    return marked.mapInArrow(run, "bundle string, n_records long, data binary")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record; payloads are tested against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for i in range(b.num_rows):
                out, size = [], 0
                for head, payload in Bundle(b.column(0)[i].as_py()).records():
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = head["WARC-Type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"])):
                        raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
                    out.append((number(head.get("X-Page-ID")), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, kind, number(head.get("X-Refers-To-Page-ID")), payload if kind == "response" else None))
                    size += len(payload)
                    if size > BUNDLE_BYTES:
                        yield batch(out)
                        out, size = [], 0
                if out:
                    yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return bundles.select("data").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as the archives hold them."""
    bundles = materialize(write_bundles(mark_revisits(table(spark, sf_dir, "pages"))), "warc")
    return read_bundles(bundles).drop("url", "payload")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha256(x) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
