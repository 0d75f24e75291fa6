"""Reading an operation log as a table: what is alive at which position.

An insert of a live id is refused, a delete of an unknown id does nothing, a delete ends a life; so a
life begins with the first insert after the last delete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live_set(ops: DataFrame, upto: int | None = None) -> DataFrame:
    """(point_id, weight, coords, seq) of the points alive after position ``upto`` (null: at the end).

    Two aggregates over the id, both combined before the shuffle; no sort.
    """
    rows = ops if upto is None else ops.where(F.col("seq") <= upto)
    dead = rows.where("op = 0").groupBy("point_id").agg(F.max("seq").alias("dead"))
    alive = rows.where("op = 1").join(dead, "point_id", "left").where("dead is null or seq > dead")
    first = alive.groupBy("point_id").agg(F.min("seq").alias("seq"), F.min_by("weight", "seq").alias("weight"), F.min_by("coords", "seq").alias("coords"))
    return first.select("point_id", "weight", "coords", "seq")


def lives(ops: DataFrame) -> DataFrame:
    """(point_id, weight, coords, seq_in, seq_out): each life as a half-open interval; seq_out is null while it lasts."""
    w = Window.partitionBy("point_id").orderBy("seq")
    rows = ops.withColumn("_before", F.lag("op").over(w))
    # an insert starts a life if nothing or a delete came before it; the next delete ends it
    rows = rows.where((F.col("op") != F.coalesce("_before", F.lit(0))))
    rows = rows.withColumn("seq_out", F.lead("seq").over(w))
    return rows.where("op = 1").select("point_id", "weight", "coords", F.col("seq").alias("seq_in"), "seq_out")


def live_at(ops: DataFrame, every: int, last: int) -> DataFrame:
    """(checkpoint, point_id, weight, coords): the live points after positions 0, every, 2 * every, ... up to ``last``.

    Each life lists the checkpoints it covers, so no range join is needed.
    """
    first = F.ceil(F.col("seq_in") / every) * every
    end = F.least(F.coalesce(F.col("seq_out") - 1, F.lit(last)), F.lit(last))
    final = F.floor(end / every) * every
    rows = lives(ops).withColumns({"_first": first.cast("long"), "_final": final.cast("long")}).where("_first <= _final")
    return rows.select(F.explode(F.sequence("_first", "_final", F.lit(every).cast("long"))).alias("checkpoint"), "point_id", "weight", "coords")


def lazy_delete(points: DataFrame, deletes: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, tombstones) after deletes: if none of the deleted ids is in the summary, they are only noted; else all of them are removed."""
    gone = deletes.select("point_id").distinct()
    if summary.join(gone, "point_id", "left_semi").isEmpty():
        return points, gone
    return points.join(gone, "point_id", "left_anti"), gone.limit(0)
