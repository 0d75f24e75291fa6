"""Removal of word sequences that repeat across documents, found by difference-cover anchors.

Two equal runs of ``window`` words may start anywhere. Positions are taken modulo ``PERIOD``; the
cover set ``COVER`` holds, for every difference d, two members that differ by d, so among the
first PERIOD offsets of the runs there is one at which both positions are in the cover. Hence
only cover positions are hashed (6 of 31), each over window - PERIOD + 1 words: any long match
shares such an aligned anchor. A window all of whose anchors occur in one document alone cannot
repeat; around shared anchors the match is extended to all 50 words by hashing the full windows,
and a window goes if its sequence starts in a document with a smaller doc_id.

Both steps are one exchange. Documents are cut by (doc_id, text) into parts of about ``PART_BYTES`` of text.
A part sends its distinct hashes with its smallest and largest doc_id, packed into one binary row
for each hash bucket; a bucket sorts what it gets and answers each part with the hashes that
matter to it. So a passage that a third of all documents share costs a part one entry, rows
in the JVM are few, and a task holds one part or one bucket. Texts are shuffled once; all steps
read that exchange. Texts too short for a window, and rows without a doc_id, skip it: nothing of them can go.

Windows are told apart by 128 bits, words by 64-bit hashes.

Defined results: null text has no words; documents of fewer words than a window keep them all; a very long text
is searched whole (a part then holds that text); rows that repeat a doc_id are one document with several texts: they do
not remove from each other; equal rows are searched once and give equal rows; of equal windows (ties) the one in the
smallest doc_id stays; a null doc_id never counts as smaller and nothing of it is removed; an empty table gives an
empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.llm.text import slices, window_hashes, word_hashes
from driftsum.session import materialize, splittable, table

WINDOW = 50
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
PART_BYTES = 6 << 20
#: Odd multipliers of the three polynomial hashes.
ANCHOR, WINDOW_LOW, WINDOW_HIGH = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_U = np.uint64
_MASK = np.zeros(PERIOD, bool)
_MASK[list(COVER)] = True


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def anchors(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the cover and the hashes of the window - PERIOD + 1 words from there."""
    all_of_them = window_hashes(hashes, window - PERIOD + 1, ANCHOR)
    at = np.flatnonzero(np.resize(_MASK, len(all_of_them)))
    return at, all_of_them[at]


def windows(hashes: np.ndarray, window: int) -> np.ndarray:
    """A structured array (low, high) for the window that starts at each word."""
    low = window_hashes(hashes, window, WINDOW_LOW)
    out = np.empty(len(low), [("low", "u8"), ("high", "u8")])
    out["low"], out["high"] = low, window_hashes(hashes, window, WINDOW_HIGH)
    return out


def near_anchor(n: int, at: np.ndarray, shared: np.ndarray, window: int) -> np.ndarray:
    """Of the n - window + 1 windows, those with a shared anchor among their first PERIOD positions."""
    hits = np.zeros(n + 1, np.int64)
    hits[at[shared] + 1] = 1
    hits = np.cumsum(hits)
    start = np.arange(n - window + 1)
    return hits[np.minimum(start + PERIOD, n)] > hits[start]


def _reduce(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with the least ``low`` and the largest ``high`` of each."""
    order = np.argsort(keys, kind="stable") if keys.dtype.names is None else np.lexsort((keys["high"], keys["low"]))
    keys, low, high = keys[order], low[order], high[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)) if len(first) else (keys, low, high)


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of ``data``; ``starts`` are their first elements."""
    ends = np.append(starts, len(data)).astype(np.int64) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def _pack(keys: np.ndarray, low: np.ndarray, high: np.ndarray, part: int, buckets: int) -> pa.Table:
    """Rows (bucket, part, keys, low, high) of a part's sorted distinct keys."""
    top = keys if keys.dtype.names is None else keys["low"]
    bucket = ((top >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int32)  # rises with the sorted keys
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return pa.table([pa.array(bucket[starts]), pa.array(np.full(len(starts), part, np.int32)), *(_binary(x, starts) for x in (keys, low, high))], schema=_SENT_ARROW)


_SENT = "bucket int, part int, keys binary, low binary, high binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_BACK = "part int, kind int, keys binary, low binary"
_BACK_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("low", pa.binary())])


def _answers(sent: DataFrame, kind: int, dtype, matters: Callable) -> DataFrame:
    """(part, kind, keys, low): to each part those of its keys that matter, with the least doc_id of all parts.

    ``matters(low, high, least, largest)`` compares the part's own extremes with those over all parts.
    """

    def run(group: pa.Table) -> pa.Table:
        parts = group.column("part").to_pylist()
        read = lambda name, t: [np.frombuffer(x, t) for x in group.column(name).to_pylist()]
        keys, low, high = read("keys", dtype), read("low", np.int64), read("high", np.int64)
        every, least, largest = _reduce(np.concatenate(keys), np.concatenate(low), np.concatenate(high))
        to, back, firsts = [], [], []
        for part, k, lo, hi in zip(parts, keys, low, high, strict=True):
            at = np.searchsorted(every, k) if k.dtype.names is None else _find(every, k)[0]
            keep = matters(lo, hi, least[at], largest[at])
            if keep.any():
                to.append(part)
                back.append(k[keep].tobytes())
                firsts.append(least[at][keep].tobytes())
        return pa.table([pa.array(to, pa.int32()), pa.array([kind] * len(to), pa.int32()), pa.array(back, pa.binary()), pa.array(firsts, pa.binary())], schema=_BACK_ARROW)

    return sent.groupBy("bucket").applyInArrow(run, _BACK)


def _find(every: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` in the sorted distinct ``every``, and whether they are there (128-bit keys)."""
    if not len(every):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(every["low"], keys["low"])
    top = len(every) - 1
    for _ in range(4):  # keys that agree in their lower 64 bits are a handful at most
        here = np.minimum(at, top)
        at = np.where((every["low"][here] == keys["low"]) & (every["high"][here] < keys["high"]), at + 1, at)
    at = np.minimum(at, top)
    return at, every[at] == keys


def _gather(table_: pa.Table, kind: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their least doc_ids from the answers of one kind."""
    rows = [(k, lo) for x, k, lo in zip(*(table_.column(c).to_pylist() for c in ("kind", "keys", "low")), strict=True) if x == kind]
    keys = np.frombuffer(b"".join(k for k, _ in rows), dtype)
    low = np.frombuffer(b"".join(lo for _, lo in rows), np.int64)
    order = np.argsort(keys) if keys.dtype.names is None else np.lexsort((keys["high"], keys["low"]))
    return keys[order], low[order]


def _documents(group: pa.Table, copies: dict[int, str]) -> Iterator[tuple[int, list[bytes], bool, int]]:
    """doc_id, words, whether the text is a copy of one with a smaller doc_id, and how many rows it stands for."""
    for batch in group.select(["doc_id", "text", "times"]).to_batches(max_chunksize=64):
        for doc, text, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            copy = doc in copies and hashlib.md5(text.encode(), usedforsecurity=False).hexdigest() in copies[doc]
            yield doc, words_of(text), copy, times


def _untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and kept of rows of which nothing can go."""
    for b in slices(batches):
        words = [words_of(t) for t in b.column(1).to_pylist()]
        n, kept = pa.array([len(w) for w in words], pa.int64()), pa.array([b" ".join(w).decode() for w in words], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array(np.zeros(len(words), np.int64)), kept], ["doc_id", "n_words", "n_removed", "kept"])


_OUT = "doc_id long, n_words long, n_removed long, kept string"
_PAIR = np.dtype([("low", "u8"), ("high", "u8")])


def remove_repeats(docs: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept are the remaining words, joined by spaces.

    ``window`` must be larger than PERIOD.
    """
    if window <= PERIOD:
        raise ValueError(f"the window must have more than {PERIOD} words")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    possible = F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) >= 2 * window - 1)
    others, rows = rows.where(~possible).mapInArrow(_untouched, _OUT), rows.where(possible).withColumn("times", F.lit(1).cast("long"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // part_bytes))
    # a bucket holds what a few parts send; more buckets than that would only make rows of few hashes
    buckets = min(parts, 256 + parts // 4)
    digest = F.md5("text")
    keyed = rows.groupBy("doc_id", digest.alias("digest")).agg(F.count(F.lit(1)).alias("times"))
    keyed = materialize(keyed, "substring-texts")
    again = keyed.where("times > 1")
    if not again.isEmpty():  # equal rows: one stands for all
        found = rows.drop("times").withColumn("digest", digest)
        one = found.join(splittable(again, "doc_id", "digest"), ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("times").alias("times"))
        rows = found.join(again, ["doc_id", "digest"], "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("times")).unionAll(one.select("doc_id", "text", "times"))
    # equal texts: only the one with the smallest doc_id takes part in the search
    first = keyed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    part = lambda digest: F.pmod(F.xxhash64("doc_id", digest), F.lit(parts)).cast("int")
    copies = keyed.join(splittable(first, "digest"), "digest").where("doc_id > first").select(part(F.col("digest")).alias("part"), F.concat_ws(":", "doc_id", "digest").alias("id"))
    # packed by part, in the layout of the answers: kind 0 has the doc_ids and text digests of copies
    copies = copies.groupBy("part").agg(F.concat_ws(",", F.collect_set("id")).cast("binary").alias("keys"))
    copies = copies.select("part", F.lit(0).alias("kind"), "keys", F.lit(b"").alias("low"))
    texts = rows.select(part(digest).alias("part"), "doc_id", "text", "times")

    def copy_ids(back: pa.Table) -> dict[int, str]:
        found = b"".join(k for kind, k in zip(back.column("kind").to_pylist(), back.column("keys").to_pylist(), strict=True) if kind == 0)
        out: dict[int, str] = {}
        for x in found.decode().split(",") if found else ():
            doc, digest = x.split(":")
            out[int(doc)] = out.get(int(doc), "") + digest
        return out

    def send(part: int, keys: list[np.ndarray], ids: list[int], dtype) -> pa.Table:
        sizes = [*map(len, keys)]
        doc = np.repeat(np.array(ids, np.int64), sizes)
        if not keys:
            return _SENT_ARROW.empty_table()
        return _pack(*_reduce(np.concatenate(keys), doc, doc), part, buckets)

    def send_anchors(texts_: pa.Table, back: pa.Table) -> pa.Table:
        if not texts_.num_rows:
            return _SENT_ARROW.empty_table()
        skip, keys, ids = copy_ids(back), [], []
        for doc, words, copy, _ in _documents(texts_, skip):
            if not copy and len(words) >= window:
                keys.append(np.unique(anchors(word_hashes(words), window)[1]))
                ids.append(doc)
        return send(texts_.column("part")[0].as_py(), keys, ids, np.uint64)

    def candidates(words: list[bytes], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows around shared anchors."""
        hashes = word_hashes(words)
        at, keys = anchors(hashes, window)
        if not len(shared):
            return np.empty(0, np.int64), np.empty(0, _PAIR)
        hit = shared[np.minimum(np.searchsorted(shared, keys), len(shared) - 1)] == keys
        if not hit.any():
            return np.empty(0, np.int64), np.empty(0, _PAIR)
        start = np.flatnonzero(near_anchor(len(words), at, hit, window))
        return start, windows(hashes, window)[start]

    def send_windows(texts_: pa.Table, back: pa.Table) -> pa.Table:
        if not texts_.num_rows:
            return _SENT_ARROW.empty_table()
        skip, shared, keys, ids = copy_ids(back), _gather(back, 1, np.uint64)[0], [], []
        for doc, words, copy, _ in _documents(texts_, skip):
            if not copy and len(words) >= window:
                found = candidates(words, shared)[1]
                if len(found):
                    keys.append(found)
                    ids.append(doc)
        return send(texts_.column("part")[0].as_py(), keys, ids, _PAIR)

    def cut(texts_: pa.Table, back: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept": [], "times": []}
        skip, shared, (known, least) = copy_ids(back), _gather(back, 1, np.uint64)[0], _gather(back, 2, _PAIR)
        for doc, words, copy, times in _documents(texts_, skip) if texts_.num_rows else ():
            gone = np.zeros(len(words), bool)
            if len(words) >= window:
                if copy:
                    gone[:] = True
                elif len(known):
                    start, keys = candidates(words, shared)
                    at, there = _find(known, keys)
                    start = start[there & (least[at] < doc)]
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            for name, x in zip(out, (doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), times), strict=True):
                out[name].append(x)
        return pa.table({k: pa.array(v, pa.string() if k == "kept" else pa.int64()) for k, v in out.items()})

    def together(back: DataFrame, f: Callable, schema: str) -> DataFrame:
        return texts.groupBy("part").cogroup(back.groupBy("part")).applyInArrow(f, schema)

    one = _answers(together(copies, send_anchors, _SENT), 1, np.uint64, lambda lo, hi, least, largest: least < largest)
    two = _answers(together(copies.unionAll(one), send_windows, _SENT), 2, _PAIR, lambda lo, hi, least, largest: hi > least)
    out = together(copies.unionAll(one).unionAll(two), cut, f"{_OUT}, times long")
    if not again.isEmpty():
        out = out.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return out.drop("times").unionAll(others)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

