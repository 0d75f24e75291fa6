import os
import zlib

import numpy as np
import pytest

from driftsum.llm import media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 4096, 200_000])
def test_round_trip(n):
    for data in (os.urandom(n), b"hello world " * (n // 12 + 1), bytes(n)):
        payload = media.pad(data)
        assert len(payload) % 64 == 0 and len(payload) >= 64
        assert media.decode_png(media.encode_png(payload)).tobytes() == payload


def test_all_filters_are_undone():
    rng = np.random.default_rng(1)
    for _ in range(5):
        image = rng.integers(0, 256, (60, 17)).astype(np.uint8)
        kinds = rng.integers(0, 5, 60)
        lines = np.zeros((60, 18), np.uint8)
        lines[:, 0] = kinds
        for r in range(60):
            for x in range(17):
                a, b, c = (int(image[r, x - 1]) if x else 0), (int(image[r - 1, x]) if r else 0), (int(image[r - 1, x - 1]) if x and r else 0)
                p = a + b - c
                paeth = min((a, b, c), key=lambda v: (abs(p - v), [a, b, c].index(v)))
                lines[r, 1 + x] = (int(image[r, x]) - [0, a, b, (a + b) // 2, paeth][kinds[r]]) % 256
        assert (media.unfilter(lines) == image).all()


def test_damage_is_found():
    data = bytearray(media.encode_png(media.pad(b"abc" * 100)))
    for at in (0, 20, 45, len(data) - 3):
        broken = data.copy()
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.decode_png(bytes(data[:60]))


def test_hash_is_steady_and_tells_apart():
    image = np.arange(64 * 40, dtype=np.float64).reshape(40, 64) % 251
    a, b = (int(media.image_hash(x), 16) for x in (image, image + 1))
    assert (a ^ b).bit_count() <= 4 and len(media.image_hash(image)) == 16
    assert media.image_hash(image) != media.image_hash(image[::-1])


def test_hard_texts(hard, nothing):
    rows = media.read_media(media.encode_media(hard)).collect()
    texts = hard.collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    for doc, text in ((x["doc_id"], x["text"]) for x in texts if x["doc_id"] not in (None, 19)):
        raw = (text or "").encode()
        payload = media.pad(raw)
        r = by[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
    assert by[8]["media_sha256"] == by[9]["media_sha256"] and by[8]["feature"] == by[9]["feature"]
    assert media.read_media(media.encode_media(nothing)).collect() == []


def plain_png(data):
    """Width and samples of a PNG, chunk by chunk and byte by byte."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed = 8, b""
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        assert int.from_bytes(data[at + 8 + n : at + 12 + n], "big") == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = (int.from_bytes(body[i : i + 4], "big") for i in (0, 4))
            assert body[8:] == bytes([8, 0, 0, 0, 0])
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompress(packed)
    assert kind == b"IEND" and len(raw) == height * (width + 1)
    out = bytearray()
    for r in range(height):
        line = raw[r * (width + 1) : (r + 1) * (width + 1)]
        for x in range(width):
            a = out[r * width + x - 1] if x else 0
            b = out[(r - 1) * width + x] if r else 0
            assert line[0] in (0, 1, 2)
            out.append((line[1 + x] + (0, a, b)[line[0]]) % 256)
    return width, bytes(out)


def plain_hash(width, payload):
    """Box averages to 32 x 32, the cosine transform by its definition, bits above the median."""
    import math
    import statistics

    rows = [list(payload[i : i + width]) for i in range(0, len(payload), width)]

    def shrink(lines):
        n = len(lines)
        if n < 32:
            return [lines[i * n // 32] for i in range(32)]
        cut = [lines[i * n // 32 : (i + 1) * n // 32] for i in range(32)]
        return [[sum(c) / len(part) for c in zip(*part)] for part in cut]

    small = [list(x) for x in zip(*shrink([list(x) for x in zip(*shrink(rows))]))]
    wave = [[math.cos(math.pi * (2 * x + 1) * k / 64) for x in range(32)] for k in range(8)]
    low = [round(sum(wave[u][y] * small[y][x] * wave[v][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = statistics.median(low)
    return f"{int(''.join(str(int(v > middle)) for v in low), 2):016x}"


def test_query_against_plain_versions(spark):
    """Every column of every document of the smallest table; the image is stored as the encoder makes it, and read by another reader."""
    import hashlib

    import duckdb

    sf = "/root/testdata/sf0.001"
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    for r in media.op7_media(spark, sf).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.encode_png(payload)
        if len(raw) < 20_000:
            assert plain_png(stored) == (64, payload)
        assert [r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")] == [len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])]
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == plain_hash(64, payload)
