"""Near-duplicate documents by HyperMinHash registers.

A document is the set of its distinct shingles (runs of words; A-Z lower-cased). Each shingle's
64-bit hash chooses one of ``BUCKETS`` buckets; a bucket keeps the smallest rest of its hashes as a
register of 16 bits: the count of leading zeros and ``MANTISSA`` bits after the first one. Documents
whose registers agree in one of ``BUCKETS / ROWS`` bands are candidates; the share of equal
registers, corrected for chance collisions of compressed registers, drops those far below the
threshold, and the rest is confirmed on the full shingle sets.

A pair at the threshold misses all bands with probability (1 - 0.85**4)**32 = 6e-11 (0.8: 5e-8).

No pair list is ever made of a bucket. Equal sets become one node first. Within a bucket, registers
alone are compared, and what goes on is a forest that connects likely pairs: at most one edge a
member. Its components are clusters; every true link lies inside one. A cluster's documents are
confirmed against its smallest one; in clusters that this leaves in several components, the
documents outside the largest are confirmed against all, until they are joined or every likely
pair was tested. Buckets and clusters of any size are cut into units of bounded memory. Shingles are
told apart by 64-bit hashes.

Defined results: null text, and text without words, is an empty set, linked with nothing; fewer
words than a shingle has form one shingle; a very long text is one set, whole; a null doc_id links nothing and its row stays; rows that
repeat a doc_id stand for the same node; of equal texts (ties) the smallest doc_id stands for all; an empty table gives
an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.llm.components import components
from driftsum.llm.text import shingle_hashes, slices, word_hashes
from driftsum.session import materialize, release, small_batches, splittable, table

BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
WORDS, PERCENT = 5, 80  # five words, similarity 0.8
BLOCK, CLUSTER = 2048, 256
SET_BYTES = 64 << 20  # of the shingle sets that a unit of a cluster holds; one larger set is a unit
SIGMAS = 5.0
_U = np.uint64
_REST = 57  # bits left of a hash after the choice of one of 128 buckets


def shingles(text: str | None, size: int) -> np.ndarray:
    return shingle_hashes(word_hashes((text or "").encode().lower().split()), size)


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers from sorted distinct hashes; 0 is an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    bucket = (hashes >> _U(_REST)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # the smallest of each bucket
    rest = hashes[first] & _U((1 << _REST) - 1)
    short = np.where(rest >> _U(53), rest & ~_U(31), rest)  # exact as a double, with as many bits
    bits = np.frexp(short.astype(np.float64))[1].astype(np.int64)
    down, up = np.maximum(bits - MANTISSA - 1, 0).astype(np.uint64), np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64)
    mantissa = ((rest >> down) << up) & _U((1 << MANTISSA) - 1)
    out[bucket[first]] = ((_U(_REST) - bits.astype(np.uint64)) << _U(MANTISSA) | mantissa) + _U(1)
    return out


def collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that two different minima share a register, for sets of n and m shingles.

    With densities n e^(-nx) and m e^(-mx) and cells about 0.72 x / 2**MANTISSA wide, the integral over x.
    """
    return 0.72 / (1 << MANTISSA) * n * m / np.maximum(n + m, 1) ** 2


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of register rows, and the number of buckets that they rest on."""
    used = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1) / np.maximum(used, 1)
    c = collisions(n, m)
    return (same - c) / (1 - c), used


def likely(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that may reach the threshold: sizes allow it, and the estimate is within SIGMAS deviations."""
    j, used = estimate(a, b, n, m)
    t = percent / 100
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return fits & (j >= t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1e-9)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, h1, h2, sig binary): size, 128-bit hash and registers of each document's set; h1 is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, h1, h2, sig = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, words)
                x = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                h1.append(int.from_bytes(x[:8], "little", signed=True) if len(s) else None)
                h2.append(int.from_bytes(x[8:], "little", signed=True) if len(s) else None)
                sig.append(registers(s).tobytes() if len(s) else None)
            cols = [pa.array(x, k) for x, k in ((n, pa.int64()), (h1, pa.int64()), (h2, pa.int64()), (sig, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n", "h1", "h2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node): a row for each band with a register that is not empty."""
    part = lambda i: F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))
    empty = F.lit(bytearray(2 * ROWS))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.when(part(i) != empty, F.xxhash64(i, part(i))))
    return nodes.select(F.explode(keys).alias("key"), "node").where("key is not null")


def _cut(rows: DataFrame, size: str, block: int) -> DataFrame:
    """``rows`` with unit (i, j) and side: groups of ``size`` rows are cut by hash into parts of about ``block``; each pair of parts is a unit."""
    cuts = F.ceil(F.col(size) / block)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), cuts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cuts - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other")


def _merge(root: np.ndarray, at: np.ndarray) -> None:
    """Give all rows of the groups of ``at`` the smallest root of these."""
    groups = np.unique(root[at])
    root[np.isin(root, groups)] = groups[0]


def _bucket_roots(side: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """The smallest row with which each row of a unit is connected over likely pairs."""
    root = np.arange(len(n))
    one_set = not side.any()
    right = np.flatnonzero(side) if not one_set else root.copy()
    for k in range(len(n)) if one_set else np.flatnonzero(side == 0):
        at = right[k + 1 :] if one_set else right
        at = at[root[at] != root[k]]
        if len(at):
            at = at[likely(sig[k], sig[at], n[k], n[at], percent)]
            if len(at):
                _merge(root, np.append(at, k))
    return root


def _likely_edges(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect, in each bucket, what likely pairs connect; at most one for each member of a unit."""
    rows = shared.select("key", "node", "size").join(nodes.select("node", "n", "sig"), "node")
    rows = _cut(rows, "size", BLOCK).select("key", "i", "j", "node", "side", "n", "sig")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def solve(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Whole units, one after the other; those of two rows, by far the most, are tested at once."""
        key, i, j, node, side, n, sig = cols
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        size = np.diff(np.append(start, len(key)))
        a = start[size == 2]
        a = a[likely(sig[a], sig[a + 1], n[a], n[a + 1], percent)]
        found = [(node[a], node[a + 1])]
        for lo, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            part = slice(lo, lo + m)
            root = _bucket_roots(side[part], n[part], sig[part], percent)
            at = np.flatnonzero(root != np.arange(m))
            found.append((node[part][root[at]], node[part][at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in range(6)] + [np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint16).reshape(-1, BUCKETS)]
            if rest:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            # the last unit may go on in the next batch
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            end = len(same) - int(same.sum())
            if end:
                yield from solve([x[:end] for x in cols])
            rest = [x[end:] for x in cols]
        if rest:
            yield from solve(rest)

    return rows.mapInArrow(run, "a long, b long").distinct()


def _reaches(common: int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


def _verify_stars(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    A centre a with many partners is dealt out to groups of about 256; within a group rows stream
    past the centre's set, so a task holds one set at a time.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 256).alias("groups")).where("groups > 1")
    salted = pairs.join(splittable(many, "a"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1))).alias("salt"))
    members = salted.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("role"))
    centres = salted.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0).alias("role")).distinct()
    rows = texts.hint("merge").join(members.unionAll(centres), "doc_id").select("a", "salt", "role", "doc_id", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for b in slices(batches):
            found: tuple[list, list] = ([], [])
            for a, salt, role, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (a, salt):
                    at, sets = (a, salt), []
                s = shingles(text, words)
                if role == 0:
                    sets.append(s)
                elif any(_reaches(len(np.intersect1d(c, s, assume_unique=True)), len(c), len(s), percent) for c in sets):
                    found[0].append(a)
                    found[1].append(doc)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


class _Minor:
    """A part of a cluster's documents outside its largest component, and the links found for them."""

    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent
        self.rows: list[tuple] = []
        self.joined: dict[int, int] = {}

    def root(self, label: int) -> int:
        while label in self.joined:
            label = self.joined[label]
        return label

    def read(self, rows: list[tuple[int, int, str]]) -> list[tuple]:
        out = []
        for node, label, text in rows:
            s = shingles(text, self.words)
            out.append((node, label, s, registers(s), len(s)))
        return out

    def meet(self, rows: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
        """Pairs of linked documents that join two components; every likely pair of different components is tested."""
        others = self.read(rows)
        sigs, sizes = np.stack([x[3] for x in others]), np.array([x[4] for x in others])
        for node, label, s, sig, n in self.rows:
            at = np.flatnonzero(likely(sig, sigs, n, sizes, self.percent))
            agree = (sigs[at].view(np.uint64) == sig.view(np.uint64)) & (sig.view(np.uint64) > 0)
            for k in at[agree.any(axis=1)].tolist():
                node_b, label_b, t, _, m = others[k]
                a, b = self.root(label), self.root(label_b)
                if a != b:
                    place = np.minimum(np.searchsorted(s, t), n - 1)
                    if _reaches(int((s[place] == t).sum()), n, m, self.percent):
                        self.joined[max(a, b)] = min(a, b)
                        yield node, node_b


def _units(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(cluster, i, j, role, node, label, text): the units of work of clusters.

    In clusters of three documents or more that still hold several components, the members outside the
    largest one (minor) meet all members. Both are cut into parts of about CLUSTER; a pair of parts is
    one unit of work: its minor part, of about SET_BYTES at most, is held, the other one streams past.
    """
    by = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    by = by.groupBy("cluster").agg(F.max(F.struct("c", "label", "n")).alias("top"), F.sum("c").alias("size"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    by = by.where("labels > 1 and size > 2")
    tall = F.greatest(F.ceil((F.col("size") - F.col("top.c")) / CLUSTER), F.ceil((F.col("n") - F.col("top.n")) * 8 / SET_BYTES))
    by = by.select("cluster", F.col("top.label").alias("top"), F.ceil(F.col("size") / CLUSTER).alias("wide"), tall.alias("tall"))
    rows = members.join(splittable(by, "cluster"), "cluster").withColumn("h", F.xxhash64("node"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    everyone = rows.select("*", F.pmod("h", F.col("wide")).alias("j"), numbers("tall").alias("i"), F.lit(1).alias("role"))
    minor = rows.where("label <> top").select("*", numbers("wide").alias("j"), F.pmod(F.shiftrightunsigned("h", 20), F.col("tall")).alias("i"), F.lit(0).alias("role"))
    names = ["cluster", "i", "j", "role", "node", "label"]
    units = everyone.select(*names).unionAll(minor.select(*names))
    units = texts.withColumnRenamed("doc_id", "node").hint("merge").join(units, "node").select(*names, "text")
    return units.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "role")


def _verify_blocks(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between different components (label) of one cluster, as many as join what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = None, _Minor(words, percent)
        for b in slices(batches, 128):
            rows = [*zip(*(c.to_pylist() for c in b.columns), strict=True)]
            found = []
            for key, group in groupby(rows, key=lambda r: r[:4]):
                if key[:3] != at:
                    at, part = key[:3], _Minor(words, percent)
                docs = [r[4:] for r in group]
                if key[3] == 0:
                    part.rows += part.read(docs)
                elif part.rows:
                    found += part.meet(docs)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return _units(members, texts).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets; component_id is
    the smallest doc_id reachable over links; a document is kept if it is its own.
    """
    small_batches(docs.sparkSession)
    sigs = materialize(signatures(docs, words), "minhash-signatures")
    total = sigs.count()  # from the files' footers
    sets = sigs.where("h1 is not null and doc_id is not null")
    classes = sets.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    nodes = materialize(sets.join(splittable(classes, "h1", "h2"), ["h1", "h2"]).where("doc_id = node").select("node", "n", "sig"), "minhash-nodes", 8 * total)  # wide rows

    bands = _bands(nodes)
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size"))
    shared = materialize(bands.join(splittable(shared.where("lo < hi").select("key", "size"), "key"), "key").select("key", "node", "size"), "minhash-shared", BANDS * total)
    clusters = materialize(components(_likely_edges(shared, nodes, percent), total), "minhash-clusters", total)

    # only documents of clusters can be linked: the texts of the others are not read again. They may be any
    # share of all documents, so the ids are not broadcast
    ids = clusters.select(F.col("node").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = materialize(texts.hint("merge").join(ids, "doc_id", "left_semi"), "minhash-texts")
    stars = clusters.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    edges = materialize(_verify_stars(stars, texts, words, percent), "minhash-edges", total)
    labels = components(edges, total).select("node", F.col("root").alias("label"))
    members = clusters.join(labels, "node", "left").join(nodes.select("node", "n"), "node")
    members = members.select("node", "n", F.col("root").alias("cluster"), F.coalesce("label", "node").alias("label"))
    more = materialize(_verify_blocks(materialize(members, "minhash-members", total), texts, words, percent), "minhash-edges", total)
    roots = components(edges.unionAll(more), 2 * total)
    release(shared, texts, nodes)

    known = classes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    out = sigs.join(splittable(known, "h1", "h2"), ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; three words, similarity 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id.

    Of rows that repeat a doc_id the one with the smallest text stays; rows without a doc_id stay.
    """
    marks = materialize(near_duplicates(docs), "minhash-marks")
    out = docs.join(marks.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
    again = marks.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    one = out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"))
    return out.join(again, "doc_id", "left_anti").select(docs.columns).unionAll(one.select("row.*"))
