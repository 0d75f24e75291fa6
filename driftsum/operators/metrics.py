"""Costs of solutions and comparisons of solutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsum.functions import rng
from driftsum.operators.clustering import Centres, assign, cluster_means


def sq_cost(points: DataFrame, centres: Centres) -> DataFrame:
    """(cost, weight, avg_cost): weighted squared distances, all weights, their quotient."""
    return assign(points, centres).agg(F.sum(F.col("weight") * F.col("d2")).alias("cost"), F.sum("weight").alias("weight")).withColumn("avg_cost", F.col("cost") / F.col("weight"))


def label_cost(points: DataFrame, dims: int) -> DataFrame:
    """The cost of the labelling in column ``label``: each label's weighted mean is a centre, points go to the nearest."""
    rows = cluster_means(points.withColumnRenamed("label", "cluster_id"), dims).collect()  # one row for each label
    return sq_cost(points, [(r["cluster_id"], [r[f"c{i}"] for i in range(dims)]) for r in sorted(rows, key=lambda r: r["cluster_id"])])


def distortion(ton_t: float, ton_x: float, xon_x: float, xon_t: float) -> float:
    """The worst ratio between costs on the whole table (t) and on a summary (x), for the solutions of both."""
    pairs = ((ton_t, ton_x), (ton_x, ton_t), (xon_x, xon_t), (xon_t, xon_x))
    return max(_ratio(a, b) for a, b in pairs)


def _ratio(a: float, b: float) -> float:
    """a / b; equal costs, both 0 included, are 1 apart, and no cost is infinitely far from some."""
    return 1.0 if a == b else a / b if b else float("inf")


def quality(ton_t: float, xon_t: float) -> float:
    return _ratio(ton_t, xon_t)


def rand_index(points: DataFrame, first: str, second: str, pairs: int, seed: int) -> DataFrame:
    """(rand_index): the agreement of two labellings, columns ``first`` and ``second``, over random pairs weighted by both weights; 0 for no points.

    Pairs are drawn by row number in id order of a table of labels; two equi-joins fetch their rows.
    """
    from driftsum.operators.sampling import bucket

    spark = points.sparkSession
    from pyspark.sql import Window

    rows = points.select("point_id", "weight", F.col(first).alias("p"), F.col(second).alias("q"), bucket(F.col("point_id")).alias("bucket"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("point_id")))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("everything"))
    rows = rows.join(F.broadcast(sizes), "bucket").withColumn("at", F.col("before") + F.col("n") - 1)
    total = sizes.select("everything").limit(1)
    draws = spark.range(pairs).join(F.broadcast(total)).select("id", rng.index(seed, "left", F.col("everything"), F.col("id")).alias("a"), rng.index(seed, "right", F.col("everything"), F.col("id")).alias("b"))
    side = lambda x: rows.select(F.col("at").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("weight", "p", "q")])
    joined = draws.join(side("a"), "a").join(side("b"), "b").withColumn("w", F.col("weight_a") + F.col("weight_b"))
    agree = (F.col("p_a") == F.col("p_b")) == (F.col("q_a") == F.col("q_b"))
    return joined.agg(F.coalesce(F.sum(F.when(agree, F.col("w")).otherwise(0.0)) / F.sum("w"), F.lit(0.0)).alias("rand_index"))
