"""Builders of point sets and operation logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftsum.functions import rng
from driftsum.operators.sampling import bucket
from driftsum.operators.small import uniform
from driftsum.session import materialize

PIECE = 100_000  # operations of a log that are given away at once
#: Days before each month of a leap year, kept for all years.
DAYS_BEFORE = (0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)


def dedupe_weight(points: DataFrame) -> DataFrame:
    """Equal coordinates become one point (the smallest id) that weighs their number."""
    return points.groupBy("coords").agg(F.min("point_id").alias("point_id"), F.count(F.lit(1)).cast("double").alias("weight")).select("point_id", "weight", "coords")


def shuffled(rows: DataFrame, seed: int, key: str = "point_id") -> DataFrame:
    """The rows in a random order that the seed fixes."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)


def grid(spark: SparkSession, n: int) -> DataFrame:
    """n points on a square grid, row by row."""
    width = int(n**0.5)
    width += width * width < n
    i = F.col("id")
    return spark.range(n).select(i.alias("point_id"), F.lit(1.0).alias("weight"), F.array(F.floor(i / width).cast("double"), (i % width).cast("double")).alias("coords"))


def block_skip(rows: DataFrame, position: Column, size: int = 1000, every: int = 3) -> DataFrame:
    """Every ``every``-th block of ``size`` rows by their position, with new positions (column point_id) from 0.

    The new position is arithmetic on the old one, so nothing is sorted or numbered.
    """
    kept = rows.withColumn("_at", position.cast("long")).where(F.pmod(F.floor(F.col("_at") / size), F.lit(every)) == 0)
    return kept.withColumn("point_id", F.floor(F.col("_at") / (size * every)) * size + F.col("_at") % size).drop("_at")


def hours(ts: Column) -> Column:
    """Hours since the year began, by the fixed table of a leap year; days count from 1."""
    table = F.array(*[F.lit(d) for d in DAYS_BEFORE])
    days = F.element_at(table, F.month(ts)) + F.dayofmonth(ts)
    return days * 24 + F.hour(ts) + F.minute(ts) / F.lit(60.0) + F.second(ts) / F.lit(3600.0)


def trip_features(trips: DataFrame, start: str, end: str, *coords: str) -> DataFrame:
    """start_h, end_h, dur_h and the coordinates of the trips whose start lies before their end."""
    rows = trips.where(F.col(start) < F.col(end))
    return rows.select("point_id", hours(F.col(start)).alias("start_h"), hours(F.col(end)).alias("end_h"), (hours(F.col(end)) - hours(F.col(start))).alias("dur_h"), *coords)


def numbered(points: DataFrame, key: str = "point_id") -> DataFrame:
    """``points`` with ``at``, their position in (bucket, id) order, from windows inside buckets and offsets of the buckets."""
    rows = points.withColumn("bucket", bucket(F.col(key)))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("bucket").orderBy(key)))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(sizes), "bucket").withColumn("at", F.col("_before") + F.col("_n") - 1).drop("bucket", "_n", "_before")


def ranked(points: DataFrame, key: str = "point_id") -> DataFrame:
    """``points`` with ``at``, their position in the order of ``key``.

    They are sorted by ranges and written, so that positions inside a partition and the counts of the partitions before it
    (one number for each) belong to one and the same sort.
    """
    rows = materialize(points.orderBy(key).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(sizes, "_part").withColumn("at", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_id", "_before")


def sliding_window(points: DataFrame, window: int, p: float, seed: int) -> DataFrame:
    """(seq, point_id, op, weight, coords): insert window + 1 points; then each step inserts the next one if its coin is below p, else deletes the oldest; it ends with the source or an empty window.

    Set-wise: running counts of the coins give each step's insert or delete rank, which is a position in the
    source. Steps are numbered by blocks with offsets, so the coins are not sorted in one task.
    """
    spark = points.sparkSession
    source = ranked(points)
    n = points.count()
    steps = spark.range(2 * n + 2).select(F.col("id").alias("t"), (rng.uniform(seed, "coin", F.col("id")) < p).cast("int").alias("ins"))
    block = 4096
    steps = steps.withColumn("block", F.floor(F.col("t") / block))
    inside = Window.partitionBy("block").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("up", F.sum("ins").over(inside)).withColumn("down", F.count(F.lit(1)).over(inside) - F.col("up"))
    sums = steps.groupBy("block").agg(F.sum("ins").alias("_u"), F.sum(1 - F.col("ins")).alias("_d"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("block", F.coalesce(F.sum("_u").over(before), F.lit(0)).alias("_ub"), F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_db"))
    steps = steps.join(sums, "block").withColumn("up", F.col("up") + F.col("_ub")).withColumn("down", F.col("down") + F.col("_db"))
    first = min(window + 1, n)
    # the step at which the source has no next point, or the window gets empty
    end = steps.where((F.col("up") + first > n) | (F.col("up") + first - F.col("down") <= 0)).agg(F.min("t")).first()[0]
    last = steps.where((F.col("up") + first - F.col("down") <= 0) & (F.col("t") == end)).count()  # the delete that empties the window still happens
    steps = steps.where(F.col("t") < F.lit((end if end is not None else 2 * n + 2) + last))
    moves = steps.select((F.lit(first) + F.col("t")).alias("seq"), F.when(F.col("ins") == 1, F.lit(first) + F.col("up") - 1).otherwise(F.col("down") - 1).alias("at"), F.col("ins").alias("op"))
    start = spark.range(first).select(F.col("id").alias("seq"), F.col("id").alias("at"), F.lit(1).alias("op"))
    return start.unionAll(moves).join(source, "at").select("seq", "point_id", "op", "weight", "coords")


def _random_victims(points: DataFrame, seed: int, plan) -> DataFrame:
    """A log in which deletes hit random live points.

    Which point is alive depends on all steps before, so the log of positions is made in one task, which holds the positions of
    the live points and gives the log away in pieces; the points are joined to it afterwards. The log is written first, for the
    planner would take what is made from a single row for small, and broadcast it through the driver whatever its length. Step t uses the
    numbers of t: a coin, and a victim's place in the list, whose last entry then takes that place.
    """
    spark = points.sparkSession
    n = points.count()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _ in range(len(batch)):
                live: list[int] = []
                log: list[tuple[int, int, int]] = []
                step = following = 0
                for insert in plan(live, lambda: uniform(seed, "coin", step)):  # noqa: B023
                    if insert:
                        if following >= n:
                            break
                        live.append(following)
                        log.append((step, following, 1))
                        following += 1
                    else:
                        if not live:
                            break
                        i = int(uniform(seed, "victim", step) * len(live))
                        live[i], live[-1] = live[-1], live[i]
                        log.append((step, live.pop(), 0))
                    step += 1
                    if len(log) == PIECE:
                        yield pd.DataFrame(log, columns=["seq", "at", "op"])
                        log = []
                yield pd.DataFrame(log, columns=["seq", "at", "op"])

    log = materialize(spark.range(1, numPartitions=1).mapInPandas(run, "seq long, at long, op int"), "random-log")
    return log.join(ranked(points), "at").select("seq", "point_id", "op", "weight", "coords")


def constant_window(points: DataFrame, window: int, total: int, p: float, seed: int, steps: int = 5000) -> DataFrame:
    """Grow with random victims until ``total`` points live, then ``steps`` strictly alternating steps, then ``steps`` that insert when the coin is at least p."""

    def plan(live, coin) -> Iterator[bool]:
        for _ in range(window + 1):
            yield True
        while len(live) <= total:
            yield coin() < p
        for i in range(steps):
            yield i % 2 == 0
        for _ in range(steps):
            yield coin() >= p

    return _random_victims(points, seed, plan)


def snake_window(points: DataFrame, window: int, seed: int, p: float = 0.9, low: float = 0.2) -> DataFrame:
    """Shrink to ``low`` * window and grow back to window, again and again, with random victims."""

    def plan(live, coin) -> Iterator[bool]:
        for _ in range(window + 1):
            yield True
        while low < 1 and window > 0:
            while len(live) > low * window:
                yield coin() >= p
            while len(live) < window:
                yield coin() < p

    return _random_victims(points, seed, plan)
