"""Toxicity scores by FTRL-proximal logistic regression over hashed text features.

Features of a text (each counts once): its lower-cased words, pairs of neighbouring words, pairs
with one word skipped, and, so that inflected forms share evidence, the word beginnings of 4 and
6 characters; all hashed to ``BITS`` bits. FTRL keeps a learning rate for each coordinate, and
its L1 term leaves most weights at exactly zero, so a model is a few hundred numbers that go to
every task. It is never larger than 2**BITS pairs.

Training rows: of the labelled rows allowed by the caller, at most ``ROWS`` of each class, first
in the order of md5(doc_id), and at most ``FEATURES`` feature occurrences in that order. This
bound is the only sampling here; every document is scored on its whole text. The bound is kept
before rows go to the task that learns: a short column of counts, at most 2 * ``ROWS`` numbers, decides
which rows are sent.

The intercept is set in two steps: from the sample's share of toxic rows to that of all allowed rows, and
then so that a score of ``THRESHOLD`` is where the F1 of scores from ``FOLDS`` models, each over the rows that
it was not trained on, is largest (sampled rows count as many as they stand for).

Defined results: a null or empty text has no features and gets the intercept's score; a very long text is
scored whole, each distinct feature once; without labelled rows every score is 0.5; null labels are ignored;
a doc_id with several labels counts as toxic if one of them says so; of several texts with one doc_id, the
one whose features have the smallest hash is learnt from; repeated rows and ties are scored alike; an empty
table gives an empty one; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftsum.llm.text import mix, slices
from driftsum.session import materialize, release, small_batches, table

BITS, ROWS, FEATURES = 20, 8_000, 16_000_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.0, 3
THRESHOLD, FOLDS = 0.7, 4
_TOKEN = re.compile(r"\w+")
_U = np.uint64


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers."""
    words = _TOKEN.findall((text or "").lower())
    if not words:
        return np.empty(0, np.int32)
    digest = lambda xs: np.fromiter(map(xxhash.xxh64_intdigest, xs), dtype=np.uint64, count=len(xs))
    h = digest(words)
    parts = [h]
    for gap in (1, 2):
        if len(h) > gap:
            parts.append(mix(h[:-gap] * _U(3) + h[gap:] * _U(5) + _U(gap)))
    for size in (4, 6):
        parts.append(mix(digest(list({w[:size] for w in words if len(w) > size})) + _U(size)))
    return np.unique(np.concatenate(parts) >> _U(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.index] = self.weight
        return out


def score(weights: np.ndarray, bias: float, texts: list[str | None]) -> np.ndarray:
    x = np.array([bias + weights[features(t)].sum() for t in texts], dtype=float)
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Ftrl:
    """The last coordinate is the intercept; it has no L1 term."""

    def __init__(self):
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        shrunk = np.where(at == 1 << BITS, z, np.sign(z) * np.maximum(np.abs(z) - L1, 0))
        return -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        if abs(g) < 1e-4:
            return
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit(rows: list[tuple[int, np.ndarray]], share: float) -> Model:
    ftrl = Ftrl()
    for _ in range(EPOCHS):
        for label, at in rows:
            ftrl.learn(at, label)
    w = ftrl.weights(np.arange(1 << BITS))
    index = np.flatnonzero(w).astype(np.int32)
    own = (sum(y for y, _ in rows) + 0.5) / (len(rows) + 1)
    bias = float(ftrl.weights(np.array([1 << BITS]))[0]) + np.log(share / (1 - share)) - np.log(own / (1 - own))
    return Model(index, w[index], float(bias))


def best_cut(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float | None:
    """The number in the middle of the gap below which the F1 of ``x`` above it is largest; None if there is none of one class."""
    if y.all() or not y.any():
        return None
    order = np.argsort(-x, kind="stable")
    x, hits, found = x[order], np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    ends = np.append(x[1:] < x[:-1], True)  # equal scores stay together
    f1 = np.where(ends, 2 * hits / (found + hits[-1]), -1.0)
    k = int(f1.argmax())
    return float(x[k] - 1.0 if k + 1 == len(x) else (x[k] + x[k + 1]) / 2)


def fit_rows(rows: list[tuple[int, np.ndarray]], share: float) -> Model:
    """``share``: the share of toxic rows to which the intercept is set before the cut is chosen."""
    if not rows:
        return Model(np.empty(0, np.int32), np.empty(0), 0.0)
    model = _fit(rows, share)
    y = np.array([label for label, _ in rows])
    x = np.zeros(len(rows))
    for fold in range(FOLDS):
        others = [r for i, r in enumerate(rows) if i % FOLDS != fold]
        if others and len(rows) > fold:
            other = _fit(others, share)
            dense = other.dense()
            x[fold::FOLDS] = [other.bias + dense[at].sum() for _, at in rows[fold::FOLDS]]
    toxic = max(y.sum(), 1)
    # what a sampled row of each class stands for, in rows of all classes
    weight = np.where(y == 1, share / toxic, (1 - share) / max(len(y) - y.sum(), 1))
    cut = best_cut(x, y, weight) if len(rows) >= 2 * FOLDS else None
    return model if cut is None else Model(model.index, model.weight, model.bias - cut + float(np.log(THRESHOLD / (1 - THRESHOLD))))


def held_out(doc_id: str = "doc_id"):
    """The documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """One task learns from FEATURES numbers at most; what it returns to the driver is the sparse model."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.select("doc_id", "toxic", F.md5(F.col("doc_id").cast("string")).alias("at"))
    counts = dict(known.groupBy("toxic").count().collect())
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
    first = lambda y: known.where(F.col("toxic") == y).orderBy("at", "doc_id").limit(ROWS)
    sample = F.broadcast(first(1).unionAll(first(0)))  # 2 * ROWS rows of three short columns at most

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = [features(t) for t in b.column(2).to_pylist()]
            digest = [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in out]
            cols = [pa.array([len(x) for x in out], pa.int64()), pa.array(digest, pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["toxic", "at", "n", "digest", "found"])

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("toxic", "at", "text")
    rows = materialize(rows.mapInArrow(extract, "toxic int, at string, n long, digest long, found binary"), "toxicity-features")
    # one text for each doc_id, then running counts: 2 * ROWS short rows at most
    sizes = rows.groupBy("at").agg(F.min(F.struct("digest", "n")).alias("x")).select("at", "x.digest", "x.n")
    sizes = sizes.withColumn("total", F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    kept = rows.join(F.broadcast(sizes.where(F.col("total") <= FEATURES).select("at", "digest")), ["at", "digest"])
    kept = kept.groupBy("at").agg(F.first("toxic").alias("toxic"), F.first("found").alias("found"))  # repeated rows

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [(y, np.frombuffer(x, np.int32)) for b in batches for y, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if pairs:
            m = fit_rows(pairs, share)
            yield pa.RecordBatch.from_pydict({"index": [m.index.tobytes()], "weight": [m.weight.tobytes()], "bias": [m.bias]})

    got = kept.repartition(1).sortWithinPartitions("at").mapInArrow(learn, "index binary, weight binary, bias double").collect()
    release(rows)
    if not got:
        return Model(np.empty(0, np.int32), np.empty(0), 0.0)
    return Model(np.frombuffer(got[0]["index"], np.int32), np.frombuffer(got[0]["weight"]), got[0]["bias"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): the score of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.dense()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score(w, model.bias, b.column(1).to_pylist()))], ["doc_id", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.dense()
        for b in slices(batches):
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            yield b.filter(pa.array(score(w, model.bias, texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the model does not reject."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))
