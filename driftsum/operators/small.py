"""k-means and sensitivity sampling on a bounded number of rows in memory, with numpy.

For nodes of a tree and for summaries, whose size is a parameter and not a function of the data. The
numbers drawn are those of ``functions.rng``: hashes of (seed, tag, key), which SQL can restate.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from driftsum.operators import kmeans as distributed

#: More rows than this are left to the distributed operators.
MOST_ROWS = 200_000
_BUCKET_DIGITS = 4


def uniform(seed: int, tag: str, *key) -> float:
    """The same number as ``functions.rng.uniform``."""
    return int(hashlib.md5(":".join(map(str, (seed, tag, *key))).encode()).hexdigest()[:8], 16) / 4294967296.0


def uniforms(seed: int, tag: str, keys) -> np.ndarray:
    return np.array([uniform(seed, tag, k) for k in keys])


def in_bucket_order(ids: np.ndarray) -> np.ndarray:
    """Places of ``ids`` by (bucket, id), the order of ``operators.sampling``."""
    buckets = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:_BUCKET_DIGITS], 16) for i in ids.tolist()])
    return np.lexsort((ids, buckets))


def squared(coords: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows by centres."""
    out = np.zeros((len(coords), len(centres)))
    for j in range(coords.shape[1]):
        out += (coords[:, j, None] - centres[None, :, j]) ** 2
    return out


def draw(weights: np.ndarray, u) -> np.ndarray:
    """The first places at which the running sum of ``weights`` is above u times all; never a place of weight 0."""
    total = np.cumsum(weights)
    at = np.searchsorted(total, np.asarray(u) * total[-1], side="right")
    return np.minimum(at, np.flatnonzero(weights)[-1])


def seeds(coords: np.ndarray, weights: np.ndarray, k: int, number) -> list[int]:
    """Rows chosen by k-means++; ``number(step)`` gives the uniform number of a step. Fewer than k if all rows lie on the chosen ones."""
    out: list[int] = []
    nearest = np.ones(len(coords))
    for step in range(min(k, len(coords))):
        share = weights * nearest
        if not share.sum() > 0:
            break
        out.append(int(draw(share, number(step))))
        d2 = squared(coords, coords[out[-1:]])[:, 0]
        nearest = d2 if step == 0 else np.minimum(nearest, d2)
    return out


def lloyd(coords: np.ndarray, weights: np.ndarray, centres: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    for _ in range(rounds):
        cluster = squared(coords, centres).argmin(axis=1)
        w = np.bincount(cluster, weights, len(centres))
        sums = np.stack([np.bincount(cluster, weights * coords[:, j], len(centres)) for j in range(coords.shape[1])], axis=1)
        new = np.where(w[:, None] > 0, sums / np.where(w > 0, w, 1)[:, None], centres)
        moved = float(np.sqrt(((new - centres) ** 2).sum()))
        centres = new
        if moved < tolerance:
            break
    return centres


def kmeans(points: DataFrame, k: int, seed: int, rounds: int, tolerance: float) -> list[tuple[int, list[float]]]:
    """The same solution as ``operators.kmeans.kmeans`` on rows (point_id, weight, coords), which makes it if they are more than MOST_ROWS."""
    rows = points.select("point_id", "weight", "coords").limit(MOST_ROWS + 1).toArrow()
    if rows.num_rows > MOST_ROWS:
        return distributed.kmeans(points, k, seed, rounds, tolerance)
    if not rows.num_rows:
        return []
    ids = rows.column("point_id").to_numpy()
    order = in_bucket_order(ids)
    ids, weights = ids[order], rows.column("weight").to_numpy()[order]
    coords = rows.column("coords").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
    chosen = sorted(seeds(coords, weights, k, lambda step: uniform(seed, "seed", step)), key=lambda i: ids[i])
    if not chosen:
        return []
    return [(i, c.tolist()) for i, c in enumerate(lloyd(coords, weights, coords[chosen], rounds, tolerance))]


def reduce_rows(ids: np.ndarray, milli: np.ndarray, coords: np.ndarray, k: int, size: int, seed: int, node: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(point_id, is_center, w_milli, coords) of a node's rows: draws by weighted distance to k-means++ centres, and the clusters' means.

    ``size`` less the centres is the number of draws. Weights are whole thousandths: a draw has S / (draws * d) of them,
    rounded down, and a mean what the draws leave of its cluster's, 0 at least. Points that all lie on centres give
    the means only. The rows' order does not matter; the draws depend on ``seed`` and ``node``.
    """
    order = np.lexsort((milli, *coords.T[::-1], ids))
    ids, milli, coords = ids[order], milli[order], coords[order]
    at = sorted(set(seeds(coords, milli.astype(float), k, lambda step: uniform(seed, "centre", node, step))))
    if not at:  # no weight at all
        return ids[:0], np.zeros(0, bool), milli[:0], coords[:0]
    d2 = squared(coords, coords[at])
    cluster, d = d2.argmin(axis=1), np.sqrt(d2.min(axis=1))
    cost, draws = milli * d, size - len(at)
    total = np.bincount(cluster, milli, len(at))
    means = np.stack([np.bincount(cluster, milli * coords[:, j], len(at)) for j in range(coords.shape[1])], axis=1) / np.maximum(total, 1)[:, None]
    if cost.sum() > 0 and draws > 0:
        picked = draw(cost, uniforms(seed, f"draw:{node}", range(draws)))
        drawn = np.floor(cost.sum() / (draws * d[picked])).astype(np.int64)
    else:
        picked, drawn = np.empty(0, np.int64), np.empty(0, np.int64)
    left = np.maximum(0, total.astype(np.int64) - np.bincount(cluster[picked], drawn, len(at)).astype(np.int64))
    keep = total > 0
    return (
        np.concatenate([ids[picked], np.full(int(keep.sum()), -1)]), np.concatenate([np.zeros(len(picked), bool), np.ones(int(keep.sum()), bool)]),
        np.concatenate([drawn, left[keep]]), np.concatenate([coords[picked], means[keep]]),
    )
