"""Media columns: byte payloads stored losslessly as PNG images in binary columns, and image hashes.

``encode_png`` writes 8-bit grey PNG: rows of ``WIDTH`` samples, each row by the filter (none, sub
or up) whose signed residuals are smallest, one zlib stream cut into IDAT chunks, a CRC-32 for each
chunk. ``decode_png`` tests every checksum, inflates, and undoes all five filters with numpy.
``image_hash`` averages the image to 32 x 32, takes the cosine transform and compares its 8 x 8 low
frequencies with their median: 64 bits as hex.

Defined results: a null text counts as empty; an empty text gives one row of zeros; equal texts give
equal values; a very long text is one tall image, whole; frequencies equal to the median (ties) give bit 0; repeated rows
repeat; an empty table gives an empty one; other columns, whatever their names, are ignored; a damaged image raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.llm.text import slices
from driftsum.session import small_batches, table

WIDTH = 64
CHUNK = 1 << 16
LEVEL = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def encode_png(payload: bytes) -> bytes:
    """``payload`` has a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    left = np.zeros_like(rows)
    left[:, 1:] = rows[:, :-1]
    up = np.zeros_like(rows)
    up[1:] = rows[:-1]
    tries = np.stack([rows, rows - left, rows - up])
    best = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    lines = np.empty((len(rows), WIDTH + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = tries[best, np.arange(len(rows))]
    packed = zlib.compress(lines.tobytes(), LEVEL)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return _SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def _unfilter_slow(line: np.ndarray, kind: int, above: np.ndarray) -> np.ndarray:
    """Average and Paeth, in which a sample needs its left neighbour first."""
    out, a, c = np.empty(len(line), np.uint8), 0, 0
    for i, (x, b) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        if kind == 3:
            a = (x + (a + b) // 2) & 255
        else:
            p = a + b - c
            da, db, dc = abs(p - a), abs(p - b), abs(p - c)
            a = (x + (a if da <= db and da <= dc else b if db <= dc else c)) & 255
        out[i], c = a, b
    return out


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered lines (first column: the filter); runs of one filter are undone at once."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    np.cumsum(out[kinds == 1], axis=1, dtype=np.uint8, out=(sub := np.empty_like(out[kinds == 1])))
    out[kinds == 1] = sub
    todo = np.flatnonzero(kinds >= 2)
    at = 0
    while at < len(todo):
        first = last = todo[at]
        if kinds[first] == 2:
            while at + 1 < len(todo) and todo[at + 1] == last + 1 and kinds[last + 1] == 2:
                at, last = at + 1, last + 1
            start = max(first - 1, 0)
            out[start : last + 1] = np.cumsum(out[start : last + 1], axis=0, dtype=np.uint8)
        else:
            out[first] = _unfilter_slow(out[first], kinds[first], out[first - 1] if first else np.zeros_like(out[first]))
        at += 1
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image, not interlaced, as (height, width)."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, kind = 8, None, [], b""
    while kind != b"IEND":
        if at + 12 > len(data):
            raise ValueError("the image ends early")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(data) < at + 12 + n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey images are read")
            size = height, width
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if size is None:
        raise ValueError("no header")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if raw.size != size[0] * (size[1] + 1):
        raise ValueError("wrong number of samples")
    return unfilter(raw.reshape(size[0], size[1] + 1))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    """The first 8 rows of the 32-point cosine transform."""
    k, x = np.arange(8)[:, None], np.arange(32)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / 64)


def _shrink(image: np.ndarray, axis: int) -> np.ndarray:
    n = image.shape[axis]
    if n < 32:
        return np.take(image, np.arange(32) * n // 32, axis=axis)
    edges = np.arange(33) * n // 32
    shape = [-1 if i == axis else 1 for i in range(2)]
    return np.add.reduceat(image, edges[:-1], axis=axis) / np.diff(edges).reshape(shape)


def image_hash(image: np.ndarray) -> str:
    c = _cosines()
    small = _shrink(_shrink(image.astype(np.float64), 0), 1)
    low = np.round(c @ small @ c.T, 6).ravel()
    return np.packbits(low > np.median(low)).tobytes().hex()


def encode_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, media binary): each text as a PNG image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = [(t or "").encode() for t in b.column(1).to_pylist()]
            media = [encode_png(pad(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([*map(len, raw)], pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[text].cast("string"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("key", key)


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of encode_media() but the image, and what the stored image holds: payload length, SHA-256, CRC-32 of the last 64 bytes, the image's own length and SHA-256, the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for stored in b.column(2).to_pylist():
                image = decode_png(stored)
                payload = image.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), image_hash(image)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    small_batches(media.sparkSession)
    rows = media.select(media[key].alias("key"), "n_bytes", "media")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return read_media(encode_media(docs))
