"""Operation logs and label files as text, and the report sink.

A log line is: id, flag (1 insert, 0 delete), weight, coordinates; separated by tabs, spaces, commas or
semicolons. Lines that start with # are comments. Order is file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\t ,;]+"


def _fields(line: Column) -> Column:
    return F.split(F.trim(line), SEPARATORS)


def parse_ops(lines: DataFrame, dims: int, n: int | None = None) -> DataFrame:
    """(seq, point_id, op, weight, coords) of lines (seq, line); further columns in a line are ignored.

    Comments, empty lines and lines with too few or malformed numbers give no row; ``n`` keeps
    sequence numbers below n.
    """
    rows = lines.where(F.col("line").isNotNull() & ~F.ltrim("line").startswith("#"))
    if n is not None:
        rows = rows.where(F.col("seq") < n)
    f = F.transform(F.slice(_fields(F.col("line")), 1, dims + 3), lambda x: x.try_cast("double"))
    rows = rows.select("seq", f.alias("f")).where((F.size("f") == dims + 3) & ~F.exists("f", lambda x: x.isNull()))
    return rows.select("seq", F.col("f")[0].cast("long").alias("point_id"), F.col("f")[1].cast("int").alias("op"), F.col("f")[2].alias("weight"), F.slice("f", 4, dims).alias("coords"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, line) of a text file or folder without comments and empty lines, numbered from 0 by path, then by place in the file.

    A partition may hold several pieces of files in any order, so each piece (path and offset, which the scan tells) is
    counted by itself; the counts of the pieces before it (one number for each) are added to the places inside it.
    """
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    pieces = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(pieces, ["file", "block"]).select((F.col("shift") + F.col("id")).alias("seq"), "line")


def read_ops(spark: SparkSession, path: str, dims: int, n: int | None = None) -> DataFrame:
    """The log of a text file, or its first ``n`` operations."""
    return parse_ops(read_lines(spark, path), dims, n)


def parse_labels(lines: DataFrame, columns: int = 1) -> DataFrame:
    """(seq, label int, values array) of ground-truth lines: the first number is the 1-based label."""
    f = F.transform(F.slice(_fields(F.col("line")), 1, columns), lambda x: x.try_cast("double"))
    rows = lines.where(F.col("line").isNotNull() & ~F.ltrim("line").startswith("#")).select("seq", f.alias("values"))
    return rows.where((F.size("values") == columns) & ~F.exists("values", lambda x: x.isNull())).select("seq", F.col("values")[0].cast("int").alias("label"), "values")


REPORT = """op dc_t dk_t d_c dc_q dk_q oc_t ok_t o_c oc_q ok_q sc_t sk_t s_c sc_q sk_q r_t r_c rc_q rk_q t_t t_c ilp_t ilp_c miqp_t miqp_c""".split()


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows with the columns of REPORT, as text separated by spaces below a comment line with their names."""
    spark = rows.sparkSession
    head = spark.range(1).select(F.lit(-1).cast("long").alias("op"), F.lit("# " + " ".join(REPORT)).alias("value"))
    body = rows.select(F.col("op").cast("long"), F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in REPORT]).alias("value"))
    head.unionAll(body).coalesce(1).sortWithinPartitions("op").select("value").write.mode("overwrite").text(path)
