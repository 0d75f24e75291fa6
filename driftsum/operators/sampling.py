"""Weighted and uniform sampling with reproducible draws.

Points are ordered by (bucket, point_id); the bucket is made from the id by MD5, so prefix sums are windows inside buckets of
about equal size plus offsets over BUCKETS totals, whatever the ids look like: no step sorts the whole table in one
task, and the totals are 65,536 rows at most. Draws look only into the buckets that they hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftsum.functions import rng
from driftsum.session import materialize

BUCKETS = 1 << 16
CELLS = 1 << 12


def bucket(key: Column) -> Column:
    """The first 16 bits of the MD5 digest of the key's text."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int")


def prefix_sums(points: DataFrame, weight: Column, key: str = "point_id") -> DataFrame:
    """``points`` with bucket, lo and hi: the half-open interval of each point on the line of all weights."""
    rows = points.withColumn("bucket", bucket(F.col(key))).withColumn("_w", weight)
    inside = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_hi", F.sum("_w").over(inside))
    totals = bucket_totals(rows, F.col("_w"), key)
    # the offsets are BUCKETS rows, whatever the table holds
    rows = rows.join(F.broadcast(totals.select("bucket", "offset")), "bucket")
    return rows.withColumn("lo", F.col("offset") + F.col("_hi") - F.col("_w")).withColumn("hi", F.col("offset") + F.col("_hi")).drop("_w", "_hi", "offset")


def bucket_totals(points: DataFrame, weight: Column, key: str = "point_id") -> DataFrame:
    """(bucket, total, offset, everything)."""
    totals = points.groupBy(bucket(F.col(key)).alias("bucket")).agg(F.sum(weight).alias("total"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.withColumns({"offset": F.coalesce(F.sum("total").over(before), F.lit(0.0)), "everything": F.sum("total").over(everything)})


def pick(points: DataFrame, weight: Column, u: float, key: str = "point_id") -> int | None:
    """The key of one point drawn by weight with the uniform number ``u``.

    The totals of the buckets choose a bucket; only its points are then ordered. None if all weights are 0.
    """
    totals = sorted((r["bucket"], r["total"]) for r in points.groupBy(bucket(F.col(key)).alias("bucket")).agg(F.sum(weight).alias("total")).collect() if r["total"])
    everything = sum(t for _, t in totals)
    if not totals or everything <= 0:
        return None
    target, chosen = u * everything, totals[-1][0]
    for b, t in totals:
        if target < t:
            chosen = b
            break
        target -= t
    inside = points.where(bucket(F.col(key)) == chosen).select(key, weight.alias("w")).where("w > 0")
    inside = inside.withColumn("hi", F.sum("w").over(Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
    row = inside.where(F.col("hi") > target).orderBy(key).select(key).first() or inside.orderBy(F.desc(key)).select(key).first()
    return row[0]


def weighted_sample(points: DataFrame, weight: Column, k: int, seed: int, tag: str = "draw", key: str = "point_id") -> DataFrame:
    """k draws with replacement by weight: the rows of ``points`` with draw_no.

    The unit interval is cut into CELLS, a bucket lists the cells that it touches, and a draw finds its bucket in its
    own cell by an equi-join. Then only the points of drawn buckets (k at most) are ordered and summed up.
    """
    spark = points.sparkSession
    totals = bucket_totals(points, weight, key).where("total > 0 and everything > 0")
    end = F.col("offset") + F.col("total")
    touched = lambda x: F.least(F.floor(x / F.col("everything") * CELLS), F.lit(CELLS)).cast("long")
    # one cell more on each side, so that rounding loses nothing
    totals = totals.withColumn("cell", F.explode(F.sequence(touched(F.col("offset")) - 1, touched(end) + 1)))
    draws = spark.range(k).select(F.col("id").alias("draw_no"), rng.uniform(seed, tag, F.col("id")).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("long"))
    at = F.col("u") * F.col("everything")
    draws = draws.join(F.broadcast(totals), "cell").where((at >= F.col("offset")) & (at < end)).select("draw_no", "bucket", at.alias("at"), "offset")
    draws = materialize(draws, "draws", k)
    # the buckets that draws hit: BUCKETS rows at most
    rows = points.withColumn("bucket", bucket(F.col(key))).join(F.broadcast(draws.select("bucket").distinct()), "bucket", "left_semi")
    inside = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_w", weight).withColumn("_hi", F.sum("_w").over(inside))
    hit = (F.col("at") >= F.col("offset") + F.col("_hi") - F.col("_w")) & (F.col("at") < F.col("offset") + F.col("_hi"))
    return rows.join(draws, "bucket").where(hit).drop("bucket", "at", "offset", "_w", "_hi")


def merged_totals(totals: DataFrame, added: DataFrame, removed: DataFrame, weight: Column, key: str = "point_id") -> DataFrame:
    """(bucket, total): the sums of a sampling structure after points were added and removed; what the totals held before is not read again."""
    parts = [totals.select("bucket", "total")]
    for points, sign in ((added, 1), (removed, -1)):
        parts.append(points.groupBy(bucket(F.col(key)).alias("bucket")).agg((sign * F.sum(weight)).alias("total")))
    rows = parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("bucket").agg(F.sum("total").alias("total"))
    return rows.where("total > 0")


def uniform_sample(points: DataFrame, m: int, seed: int, tag: str = "uniform", key: str = "point_id") -> DataFrame:
    """m draws with replacement, all points alike."""
    return weighted_sample(points, F.lit(1.0), m, seed, tag, key)


def reservoir(points: DataFrame, weight: Column, k: int, seed: int, key: str = "point_id") -> DataFrame:
    """(slot, point): a weighted reservoir of k slots.

    The first k points fill the slots; a later one replaces a random slot with probability k * w / (sum of the
    weights so far). Whether it does is known from prefix sums, so a slot holds its last writer.
    """
    rows = prefix_sums(points, weight, key).withColumn("_w", weight)
    count = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(count))
    sizes = points.groupBy(bucket(F.col(key)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"))
    rows = rows.join(F.broadcast(sizes), "bucket").withColumn("_at", F.col("rows_before") + F.col("_n") - 1)
    accepted = rng.uniform(seed, "accept", F.col(key)) < k * F.col("_w") / F.col("hi")
    slot = F.when(F.col("_at") < k, F.col("_at")).when(accepted, rng.index(seed, "slot", k, F.col(key)))
    return rows.select(slot.alias("slot"), F.col(key).alias("point"), "_at").where("slot is not null").groupBy("slot").agg(F.max_by("point", "_at").alias("point"))
