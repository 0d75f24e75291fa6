"""Point sets and operation logs on the driver's tables.

points: (point_id long, weight double, coords array<double>); operation logs add seq and op (1 insert, 0 delete).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.session import table

#: The same point sets in DuckDB, as common table expressions with one column for each coordinate.
SQL = {
    "pts_orders": "pts_orders AS (SELECT o_orderkey AS point_id, (1 + o_orderkey % 3)::DOUBLE AS weight, o_totalprice / 1000 AS x0, dayofyear(o_orderdate)::DOUBLE AS x1 FROM orders)",
    "pts_line": """pts_line AS (SELECT ('0x' || substr(md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT, round(l_extendedprice * 100)::BIGINT)), 1, 15))::BIGINT AS point_id,
      1.0::DOUBLE AS weight, l_quantity::DOUBLE AS x0, round(l_discount * 100)::DOUBLE AS x1, round(l_tax * 100)::DOUBLE AS x2 FROM lineitem)""",
    "pts_emb": "pts_emb AS (SELECT vec_id AS point_id, 1.0::DOUBLE AS weight, embedding::DOUBLE[] AS coords, label FROM embeddings)",
    "pts_nation": """pts_nation AS (SELECT n_nationkey::BIGINT AS point_id, 1.0::DOUBLE AS weight, coalesce(c, 0)::DOUBLE AS x0, coalesce(s, 0)::DOUBLE AS x1 FROM nation
      LEFT JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY 1) USING (n_nationkey) LEFT JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS s FROM supplier GROUP BY 1) USING (n_nationkey))""",
    "pts_region": "pts_region AS (SELECT n_regionkey::BIGINT AS point_id, count(*)::DOUBLE AS weight, sum(x0) AS x0, sum(x1) AS x1 FROM pts_nation JOIN nation ON n_nationkey = point_id GROUP BY n_regionkey)",
    "ops_events": "ops_events AS (SELECT event_id AS seq, user_id AS point_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op, 1.0::DOUBLE AS weight, value AS x0, hour(ts) + minute(ts) / 60.0::DOUBLE AS x1 FROM events)",
}


def pts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price in thousands and day of the year; weights 1 to 3."""
    key = F.col("o_orderkey")
    coords = F.array(F.col("o_totalprice") / 1000, F.dayofyear("o_orderdate").cast("double"))
    return table(spark, sf_dir, "orders").select(key.alias("point_id"), (1 + key % 3).cast("double").alias("weight"), coords.alias("coords"))


def pts_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity, discount and tax; the id is a hash of the columns that make a line unique, so no global numbering is needed."""
    whole = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    parts = [F.col(c).cast("string") for c in whole] + [F.col("l_quantity").cast("long").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string")]
    key = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")
    coords = F.array(F.col("l_quantity").cast("double"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100))
    return table(spark, sf_dir, "lineitem").select(key.alias("point_id"), F.lit(1.0).alias("weight"), coords.alias("coords"))


def pts_emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.lit(1.0).alias("weight"), F.col("embedding").cast("array<double>").alias("coords"), "label")


def pts_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of customers and suppliers of each nation: 25 points at any scale."""
    counts = lambda name, key: table(spark, sf_dir, name).groupBy(F.col(key).alias("n_nationkey")).agg(F.count(F.lit(1)).cast("double").alias(name))
    rows = table(spark, sf_dir, "nation").join(counts("customer", "c_nationkey"), "n_nationkey", "left").join(counts("supplier", "s_nationkey"), "n_nationkey", "left")
    coords = F.array(F.coalesce("customer", F.lit(0.0)), F.coalesce("supplier", F.lit(0.0)))
    return rows.select(F.col("n_nationkey").cast("long").alias("point_id"), F.lit(1.0).alias("weight"), coords.alias("coords"), F.col("n_regionkey").cast("long").alias("region"))


def pts_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of each region: 5 points, weighing their nations."""
    rows = pts_nation(spark, sf_dir).groupBy(F.col("region").alias("point_id")).agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum(F.col("coords")[0]).alias("a"), F.sum(F.col("coords")[1]).alias("b"))
    return rows.select("point_id", "weight", F.array("a", "b").alias("coords"))


def ops_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dirty log: users repeat inserts, and errors delete users that may not be there."""
    coords = F.array(F.col("value"), F.hour("ts") + F.minute("ts") / F.lit(60.0))
    op = F.when(F.col("event_type") == "error", 0).otherwise(1)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("point_id"), op.alias("op"), F.lit(1.0).alias("weight"), coords.alias("coords"))


def spread(points: DataFrame, dims: int, *keep: str) -> DataFrame:
    """coords as columns x0, x1, ..."""
    return points.select(*keep, *[F.col("coords")[i].alias(f"x{i}") for i in range(dims)])
