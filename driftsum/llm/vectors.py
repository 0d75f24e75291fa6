"""Near-duplicate vectors by a subspace pigeonhole join.

On unit vectors a cosine of at least c is a squared distance of at most 2 - 2c. A fixed random
rotation spreads it over all coordinates, which are cut into blocks; in at least one block the
squared distance is at most the budget in proportion to the block's share of coordinates. Each
block is range-joined: its first coordinate falls into intervals twice as wide as the
budget's root, and a vector close above an interval's upper end also visits that interval. Pairs
within a block's budget are verified by the exact cosine, and a pair counts in the first block that
finds it, so nothing needs to be sorted out afterwards.

No pair leaves its task: a unit of work returns the number of links of each vector and the smallest
vector it is connected with there. Equal vectors become one row with a weight first. Intervals
of more than ``UNIT`` rows are cut by hash, and each pair of cuts is a unit, so memory is bounded
however many vectors an interval holds.

Defined results: vectors that are null, empty or zero or hold null or non-finite components link
with nothing (nor do those whose squared norm is not a finite positive number in double precision); so do vectors of different lengths;
very long vectors have more blocks; equal vectors (ties) are linked with each other; rows that repeat a vec_id are vectors of their own
with links of their own that share one component; a row with a null vec_id links with nothing and has no component; an empty table gives
an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.llm.components import components
from driftsum.session import materialize, splittable, table

COSINE = 0.95
BLOCK_DIMS = 16
UNIT = 16384
SEED = 20
#: Room for rounding: rotated coordinates are kept as 32-bit floats.
SLACK = 1e-4
_CHUNK, _PAIRS = 512, 1 << 15


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, cosine: float) -> list[tuple[int, int, float]]:
    """First and last coordinate and budget of each block."""
    n = -(-dim // BLOCK_DIMS)
    cuts = [dim * i // n for i in range(n + 1)]
    return [(a, b, (2 - 2 * cosine + SLACK) * (b - a) / dim) for a, b in zip(cuts, cuts[1:], strict=False)]


def rotated(x: np.ndarray) -> np.ndarray:
    return ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1]).T).astype(np.float32)


def read_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, h1, h2, vec binary): components as 64-bit floats and their digest; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            n = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0  # nulls become NaN; no negative zero
            ends, row = np.cumsum(n), np.repeat(np.arange(len(n)), n)
            with np.errstate(over="ignore", invalid="ignore"):
                square = np.bincount(row, flat * flat, len(n))  # not finite if a component is not
            ok = (n > 0) & np.isfinite(square) & (square > 0)
            raw = [flat[e - m : e].tobytes() if good else None for e, m, good in zip(ends.tolist(), n.tolist(), ok.tolist(), strict=True)]
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x or b"") for x in raw), "<i8").reshape(-1, 2)
            cols = [pa.array(halves[:, i], pa.int64(), mask=~ok) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(raw, pa.binary())], ["vec_id", "h1", "h2", "vec"])

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, h1 long, h2 long, vec binary")


def _visits(nodes: DataFrame, cosine: float, with_vectors: bool) -> DataFrame:
    """(dim, block, cell, halo, node, h1, weight[, vec]): the intervals that each vector visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(3).to_pylist()
            dims = np.array([len(x) // 8 for x in raw])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                r = rotated(np.frombuffer(b"".join(raw[i] for i in at), np.float64).reshape(-1, dim))
                for k, (lo, _, budget) in enumerate(blocks(dim, cosine)):
                    reach = budget**0.5
                    x = r[:, lo].astype(np.float64)
                    cell = np.floor(x / (2 * reach)).astype(np.int32)
                    near = np.flatnonzero(x - cell * (2 * reach) <= reach)
                    rows = np.concatenate([at, at[near]])
                    cols = [np.full(len(rows), dim, np.int32), np.full(len(rows), k, np.int32), np.concatenate([cell, cell[near] - 1]), np.arange(len(rows)) >= len(at)]
                    names = ["dim", "block", "cell", "halo", "node", "h1", "weight"] + ["vec"] * with_vectors
                    take = [b.column(i).take(pa.array(rows)) for i in range(4 if with_vectors else 3)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), *take], names)

    schema = "dim int, block int, cell int, halo boolean, node long, h1 long, weight long" + ", vec binary" * with_vectors
    return nodes.select("node", "h1", "weight", "vec").mapInArrow(run, schema)


def _join_unit(x: np.ndarray, side: np.ndarray, halo: np.ndarray, weight: np.ndarray, k: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row in block ``k`` and its root (row number): all pairs of rows, or those between the two sides; not between two visitors."""
    n, dim = x.shape
    cuts = blocks(dim, cosine)
    lo, hi, budget = cuts[k]
    r, norms = rotated(x), np.linalg.norm(x, axis=1)
    part = r[:, lo:hi]
    squares, one = (part * part).sum(axis=1, keepdims=True), np.ones((n, 1), np.float32)
    # squared distances as one matrix product: |x|^2 * 1 + 1 * |y|^2 - 2 xy
    first, second = np.hstack([part, squares, one]), np.hstack([-2 * part, one, squares]).T
    links, root = np.zeros(n, np.int64), np.arange(n)
    one_set = not side.any()
    left, right = (np.arange(n),) * 2 if one_set else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for start in range(0, len(left), _CHUNK):
        rows = left[start : start + _CHUNK]
        columns = right[start:] if one_set else right
        p, q = np.divmod(np.flatnonzero(first[rows] @ second[:, columns] <= budget + 1e-5), len(columns))
        p, q = rows[p], columns[q]
        keep = ~(halo[p] & halo[q])
        if one_set:
            keep &= p < q
        p, q = p[keep], q[keep]
        for i in range(0, len(p), _PAIRS):
            a, b = p[i : i + _PAIRS], q[i : i + _PAIRS]
            diff = (r[a].astype(np.float64) - r[b]) ** 2
            found = [diff[:, u:v].sum(axis=1) <= limit for u, v, limit in cuts[: k + 1]]
            here = found[k]
            for earlier in found[:k]:
                here = here & ~earlier
            a, b = a[here], b[here]
            linked = np.einsum("ij,ij->i", x[a], x[b]) / (norms[a] * norms[b]) >= cosine
            a, b = a[linked], b[linked]
            links += np.bincount(a, weight[b], n).astype(np.int64) + np.bincount(b, weight[a], n).astype(np.int64)
            while True:
                u, v = root[a], root[b]
                apart = u != v
                if not apart.any():
                    break
                np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
                while (root[root] != root).any():
                    root = root[root]
    return links, root


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors`` (vec_id, embedding).

    Vectors are linked if their cosine, in double precision, is at least ``cosine``.
    """
    rows = materialize(read_vectors(vectors), "vectors-rows")
    classes = rows.where("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    nodes = materialize(classes, "vectors-nodes")
    full = _visits(nodes, cosine, False).groupBy("dim", "block", "cell").count().where(F.col("count") > UNIT)
    full = full.select("dim", "block", "cell", F.ceil(F.col("count") / UNIT).alias("cuts"))
    visits = _visits(nodes, cosine, True).join(full, ["dim", "block", "cell"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    visits = visits.withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")))
    visits = visits.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    units = visits.select("dim", "block", "cell", i.alias("i"), j.alias("j"), (F.col("own") > F.col("other")).alias("side"), "halo", "node", "h1", "weight", "vec")

    def run(unit: pa.Table) -> pa.Table:
        node = unit.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        dim = unit.column("dim")[0].as_py()
        x = np.frombuffer(b"".join(unit.column("vec").to_pylist()), np.float64).reshape(-1, dim)[order]
        get = lambda name: unit.column(name).to_numpy()[order]
        links, root = _join_unit(x, get("side").astype(np.int8), get("halo").astype(bool), get("weight"), unit.column("block")[0].as_py(), cosine)
        node, at = node[order], np.flatnonzero(links)
        return pa.table({"node": node[at], "h1": get("h1")[at], "links": links[at], "root": node[root[at]]})

    found = units.groupBy("dim", "block", "cell", "i", "j").applyInArrow(run, "node long, h1 long, links long, root long")
    found = materialize(found, "vectors-links")
    counts = found.groupBy("node", "h1").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    classes = nodes.join(counts, ["node", "h1"], "left").join(roots, "node", "left")
    classes = classes.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    out = rows.select("vec_id", "h1", "h2").join(splittable(classes, "h1", "h2"), ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("root", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0)
    return out.select("vec_id", links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
