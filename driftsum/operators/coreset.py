"""Sensitivity-sampling summaries: a few weighted points that stand for a table.

A summary has ``draws`` points drawn with replacement, each by its share of the total weighted distance
to k-means++ centres, with weight S / (draws * d); and a mean for each cluster that carries
what weight the draws leave open: max(0, W - drawn weight).
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsum.operators.clustering import Centres, assign, cluster_means, with_costs
from driftsum.operators.kmeans import ordered_by_id, seed_centres
from driftsum.operators.sampling import weighted_sample


def summary_size(eps: float, lam: float, k: int, dims: int, fixed: int = 0) -> int:
    """Rows for an error of eps with probability 1 - lam; ``fixed`` overrides; -1 for parameters out of range."""
    if fixed > 0:
        return fixed
    if eps <= 0 or lam > 0.5:
        return -1
    return int(5 / eps**2 * (k * dims + log(1 / lam)))


def centre_weights(assigned: DataFrame, drawn: DataFrame) -> DataFrame:
    """(cluster_id, total, drawn, weight) of each cluster: weight = max(0, total - drawn)."""
    totals = assigned.groupBy("cluster_id").agg(F.sum("weight").alias("total"))
    sums = drawn.groupBy("cluster_id").agg(F.sum("weight").alias("drawn"))
    out = totals.join(sums, "cluster_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0.0)))
    return out.withColumn("weight", F.greatest(F.lit(0.0), F.col("total") - F.col("drawn")))


def draw(assigned: DataFrame, draws: int, seed: int, weighted: bool = True) -> DataFrame:
    """(draw_no, point_id, cluster_id, weight, coords) by sensitivity; no rows if every point lies on a centre."""
    cost = "wd" if weighted else "d"
    rows = with_costs(assigned)
    total = rows.agg(F.sum(cost)).first()[0] or 0.0
    out = weighted_sample(rows.where("d > 0"), F.col(cost), draws, seed, "sensitivity")
    return out.select("draw_no", "point_id", "cluster_id", F.try_divide(F.lit(total), draws * F.col("d")).alias("weight"), "coords")


def summarize(points: DataFrame, k: int, draws: int, seed: int, dims: int, weighted: bool = True, centres: Centres | None = None) -> DataFrame:
    """(draw_no, point_id, is_center, cluster_id, weight, coords); centres have point_id -1 and no draw_no.

    ``weighted`` false is the static form: costs, counts and means ignore the weights, seeding does not.
    """
    centres = centres or ordered_by_id(seed_centres(points, k, seed))
    assigned = assign(points, centres)
    drawn = draw(assigned, draws, seed, weighted)
    base = assigned if weighted else assigned.withColumn("weight", F.lit(1.0))
    weights = centre_weights(base, drawn).select("cluster_id", "weight")
    means = cluster_means(assigned, dims, weighted).select("cluster_id", F.array(*[F.col(f"c{i}") for i in range(dims)]).alias("coords"))
    centre_rows = weights.join(means, "cluster_id").select(F.lit(None).cast("long").alias("draw_no"), F.lit(-1).cast("long").alias("point_id"), F.lit(True).alias("is_center"), "cluster_id", "weight", "coords")
    return drawn.select("draw_no", "point_id", F.lit(False).alias("is_center"), "cluster_id", "weight", "coords").unionAll(centre_rows)


def uniform_summary(points: DataFrame, m: int, seed: int) -> DataFrame:
    """m points drawn alike with replacement; their weights are copied as they are."""
    return weighted_sample(points, F.lit(1.0), m, seed, "uniform")


def proportional_summary(points: DataFrame, m: int, seed: int, repetitions: int = 10, keep_weights: bool = False) -> DataFrame:
    """Draws by weight, ``repetitions`` times (column rep). A draw by weight stands for one unit; ``keep_weights`` counts weights twice, once in the draw and once in the row."""
    out = weighted_sample(points, F.col("weight"), m * repetitions, seed, "proportional").withColumn("rep", F.floor(F.col("draw_no") / m).cast("int"))
    return out if keep_weights else out.withColumn("weight", F.lit(1.0))
