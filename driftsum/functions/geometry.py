"""Distances between coordinate arrays, as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above so many terms (centres x dimensions) expressions fold over arrays: unrolled ones would pass the JVM's method size.
UNROLL = 240


def square_sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def sq_dist(a: Column, b: Column) -> Column:
    """Sum of squared differences; never negative, unlike norms minus twice the product."""
    return square_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l2_dist(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def sq_norm(a: Column) -> Column:
    return square_sum(F.transform(a, lambda x: x * x))


def sq_dist_to(coords: Column, centre: Sequence[float]) -> Column:
    """To a constant point, unrolled: stays inside whole-stage code."""
    terms = [(coords[i] - F.lit(float(c))) * (coords[i] - F.lit(float(c))) for i, c in enumerate(centre)]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def nearest(coords: Column, centres: Sequence[tuple[int, Sequence[float]]]) -> Column:
    """struct(d2, cluster_id) of the nearest constant centre, ties to the lowest id; neither join nor shuffle."""
    if sum(len(c) for _, c in centres) <= UNROLL:
        best = [F.struct(sq_dist_to(coords, c).alias("d2"), F.lit(int(i)).alias("cluster_id")) for i, c in centres]
        return F.least(*best) if len(best) > 1 else best[0]
    table = F.array(*[F.struct(F.lit(int(i)).alias("id"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in centres])
    return F.array_min(F.transform(table, lambda t: F.struct(sq_dist(coords, t["c"]).alias("d2"), t["id"].alias("cluster_id"))))
