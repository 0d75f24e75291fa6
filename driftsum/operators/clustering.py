"""Assignments to centres and their aggregates.

Centres are (cluster_id, coordinates) pairs on the driver: k of them, k being a parameter, never
a function of the data's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftsum.functions.geometry import nearest, sq_dist_to

Centres = Sequence[tuple[int, Sequence[float]]]


def first_centres(points: DataFrame, k: int) -> list[tuple[int, list[float]]]:
    """The coordinates of the k points with the smallest ids, numbered in that order."""
    rows = points.orderBy("point_id").limit(k).select("coords").collect()
    return [(i, list(r["coords"])) for i, r in enumerate(rows)]


def assign(points: DataFrame, centres: Centres) -> DataFrame:
    """``points`` with cluster_id and d2, the squared distance; ties go to the lowest id. Evaluated row by row, no shuffle."""
    return points.withColumn("_near", nearest(F.col("coords"), centres)).select(*points.columns, F.col("_near.cluster_id").alias("cluster_id"), F.col("_near.d2").alias("d2"))


def with_costs(assigned: DataFrame) -> DataFrame:
    """Adds d, the distance, and wd, weight times distance."""
    return assigned.withColumns({"d": F.sqrt("d2"), "wd": F.col("weight") * F.sqrt("d2")})


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def milli(weight: Column) -> Column:
    """Weights in whole thousandths: sums are exact in any order."""
    return F.floor(weight * 1000).cast("long")


def cluster_weights(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.sum(milli(F.col("weight"))).alias("w_milli"))


def truncating_count(weights: Column) -> Column:
    """The sum of an array of weights, cut to a whole number after each addition."""
    return F.aggregate(weights, F.lit(0).cast("long"), lambda s, w: (s + w).cast("long"))


def total_cost(assigned: DataFrame) -> DataFrame:
    return with_costs(assigned).agg(F.sum("d").alias("cost"))


def total_weighted_cost(assigned: DataFrame) -> DataFrame:
    return with_costs(assigned).agg(F.sum("wd").alias("cost"))


def cluster_costs(assigned: DataFrame) -> DataFrame:
    """Sum and mean of the distances of each cluster."""
    return with_costs(assigned).groupBy("cluster_id").agg(F.sum("d").alias("cost"), F.avg("d").alias("avg_cost"))


def normalized_costs(assigned: DataFrame, cost: str = "d") -> DataFrame:
    """Each point's share of the total cost (``d`` or ``wd``); 0 where the total is 0."""
    rows = with_costs(assigned)
    total = F.broadcast(rows.agg(F.sum(cost).alias("_total")))  # one row
    return rows.join(total).withColumn("share", F.when(F.col("_total") > 0, F.col(cost) / F.col("_total")).otherwise(0.0)).drop("_total")


def cluster_means(assigned: DataFrame, dims: int, weighted: bool = True) -> DataFrame:
    """(cluster_id, c0, c1, ...): means of the members, by weight or all alike. One aggregation, no explode."""
    w = F.col("weight") if weighted else F.lit(1.0)
    sums = [F.sum(w * F.col("coords")[i]).alias(f"s{i}") for i in range(dims)]
    out = assigned.groupBy("cluster_id").agg(F.sum(w).alias("w"), *sums)
    return out.where("w > 0").select("cluster_id", *[(F.col(f"s{i}") / F.col("w")).alias(f"c{i}") for i in range(dims)])


def members(assigned: DataFrame, cluster_id: int) -> DataFrame:
    return assigned.where(F.col("cluster_id") == cluster_id)


def cluster_ids(assigned: DataFrame) -> DataFrame:
    """Ids in use, with numbers from 0 in their order; k rows."""
    ids = assigned.select("cluster_id").distinct()
    return ids.withColumn("number", F.row_number().over(Window.orderBy("cluster_id")) - 1)


def max_distance_bound(points: DataFrame, origin: Sequence[float]) -> DataFrame:
    """Twice the largest distance from a fixed point: no two points are farther apart."""
    return points.agg((2 * F.sqrt(F.max(sq_dist_to(F.col("coords"), origin)))).alias("bound"))
