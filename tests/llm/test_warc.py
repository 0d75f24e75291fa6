import io
import os

import pytest
import zstandard

from driftsum.llm import warc

PAGE = "page_id long, url string, html string, payload string, digest string, n int"
LONG = "<p>" + "x" * 200


def rows():
    return [(1, "http://a", LONG), (2, None, LONG), (3, "http://b\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", LONG + "é"), (0, "u", LONG + "é"), (2, "u", LONG), (None, "u", LONG), (None, "u", LONG + "only"), (None, "u", LONG + "only"), (8, "u", "y" * 99), (9, "u", "y" * 99), (10, "u", "z" * 100), (11, "u", "z" * 100), (12, "big", "q" * 3_000_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "p", "d", 1) for r in rows()], PAGE).repartition(3)


def test_round_trip(pages):
    import hashlib

    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages))).collect()), key=repr)
    want = []
    for page, _, html in rows():
        raw = (html or "").encode()
        same = [p for p, _, h in rows() if h == html and p is not None]
        first = min(same) if same and len(raw) >= 100 else None
        refers = first if first is not None and page != first else None
        want.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=repr)


def test_random_access_and_plain_readers():
    w, expected = warc.BundleWriter(), {}
    for i in range(300):
        payload = os.urandom(5000) if i % 50 else os.urandom(600_000)
        name, record = warc.write_record(i, f"u{i}", payload, len(payload), "d" * 64, None)
        w.add(name, record)
        expected[name] = payload
    data, n = w.finish()
    assert n == 300
    b = warc.Bundle(data)
    assert set(b.index()) == set(expected) and len(b.places) > 5
    for name in list(expected)[::37]:
        assert b.fetch(name)[1] == expected[name]
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as f:
        assert f.read().count(b"WARC/1.1\r\n") >= 300
    with pytest.raises(ValueError):
        warc.Bundle(data[:-1])


def test_headers_cannot_be_split(pages):
    name, record = warc.write_record(1, "http://b\r\nX: y", b"a", 1, "d", None)
    head, payload, end = warc.read_record(record)
    assert "X" not in head and payload == b"a" and end == len(record)


def test_empty_table(pages):
    assert warc.read_bundles(warc.write_bundles(warc.mark_revisits(pages.limit(0)))).collect() == []
