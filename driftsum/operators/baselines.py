"""Reference solutions: k-means on the whole table or on simple summaries, and exact optima of tiny inputs."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsum.functions.geometry import sq_dist_to
from driftsum.operators import small
from driftsum.operators.coreset import proportional_summary, summarize, uniform_summary
from driftsum.operators.kmeans import ROUNDS, TOLERANCE, kmeans

MOST_MEDOID_POINTS, MOST_POINTS = 12, 8


def numbered_summary(summary: DataFrame) -> DataFrame:
    """A summary as points: ids are draw numbers, and after them the centres by cluster."""
    key = F.coalesce("draw_no", F.lit(1 << 40) + F.col("cluster_id")).cast("long")
    return summary.select(key.alias("point_id"), "weight", "coords")


def kmeans_full(points: DataFrame, k: int, seed: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[tuple[int, list[float]]]:
    """The solution on the whole table."""
    return kmeans(points, k, seed, rounds, tolerance)


def kmeans_summary(points: DataFrame, k: int, draws: int, seed: int, dims: int, weighted: bool = True, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[tuple[int, list[float]]]:
    """The solution on a summary by sensitivity; ``weighted`` false is the static form."""
    return small.kmeans(numbered_summary(summarize(points, k, draws, seed, dims, weighted)), k, seed, rounds, tolerance)


def kmeans_random(points: DataFrame, k: int, m: int, seed: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE, proportional: bool = False) -> list[tuple[int, list[float]]]:
    """The solution on draws, all points alike or by weight."""
    draws = proportional_summary(points, m, seed, 1) if proportional else uniform_summary(points, m, seed)
    return small.kmeans(draws.select(F.col("draw_no").alias("point_id"), "weight", "coords"), k, seed, rounds, tolerance)


def _few(points: DataFrame, most: int) -> list:
    rows = points.orderBy("point_id").limit(most + 1).select("point_id", "weight", "coords").collect()
    if len(rows) > most:
        raise ValueError(f"exact solutions are for {most} points at most")
    return rows


def exact_medoids(points: DataFrame, k: int) -> DataFrame:
    """(centres, cost): the best k points as centres, by enumeration; ties to the first in id order."""
    rows = _few(points, MOST_MEDOID_POINTS)
    at = F.array(*[F.array(*[F.lit(float(x)) for x in r["coords"]]) for r in rows])
    subsets = F.array(*[F.array(*map(F.lit, c)) for c in combinations(range(len(rows)), min(k, len(rows)))])
    frame = points.sparkSession.range(1).select(F.explode(subsets).alias("s"))
    cost = F.lit(0.0)
    for r in rows:
        cost = cost + F.lit(float(r["weight"])) * F.array_min(F.transform("s", lambda i: sq_dist_to(F.element_at(at, i + 1), r["coords"])))  # noqa: B023
    keys = F.array(*[F.lit(r["point_id"]) for r in rows])
    out = frame.select(F.transform("s", lambda i: F.element_at(keys, i + 1)).alias("centres"), cost.alias("cost"))
    return out.agg(F.min(F.struct("cost", "centres")).alias("b")).select("b.centres", "b.cost")


def exact_kmeans(points: DataFrame, k: int) -> DataFrame:
    """(labelling, cost): the best partition into at most k clusters with free centres, by enumeration.

    A labelling is a number whose base-k digits, lowest first, are the clusters of the points in id order.
    """
    rows = _few(points, MOST_POINTS)
    n, dims = len(rows), len(rows[0]["coords"])
    frame = points.sparkSession.range(k**n).select(F.col("id").alias("labelling"))
    digit = lambda i: F.floor(F.col("labelling") / k**i) % k
    cost = F.lit(0.0)
    for c in range(k):
        inside = [F.when(digit(i) == c, F.lit(float(r["weight"]))).otherwise(0.0) for i, r in enumerate(rows)]
        w = sum(inside, F.lit(0.0))
        for j in range(dims):
            first = sum((x * F.lit(float(r["coords"][j])) for x, r in zip(inside, rows, strict=True)), F.lit(0.0))
            second = sum((x * F.lit(float(r["coords"][j]) ** 2) for x, r in zip(inside, rows, strict=True)), F.lit(0.0))
            cost = cost + F.when(w > 0, second - first * first / w).otherwise(0.0)
    return frame.select("labelling", cost.alias("cost")).agg(F.min(F.struct(F.round("cost", 4).alias("cost"), "labelling")).alias("b")).select("b.labelling", "b.cost")
