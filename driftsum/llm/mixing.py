"""Mixing sources to target weights by repetition rates.

Words are counted per source (partial sums before the shuffle, so a source may hold any share of
the rows). The mix takes ``share`` times all words, dealt to the sources by weight and filled up
like connected vessels: no source gets more than ``limit`` times its own words, and what it cannot
take goes to the others by weight. A document is then emitted floor(rate) times, plus one copy if
a uniform number made from its doc_id by MD5 is below the fraction of the rate; hence reruns agree
however the rows are dealt out.

Sources are ordered by code point, null last, and take ``weights`` in turn.

The table of sources, one short row for each, is numbered and summed in one task (three windows without a
partition): meant for up to some millions of sources; the documents themselves are never gathered.

Defined results: a null text has size 0, a very long one the number of all its words; a null source is a source of its own;
sources without words get target 0; sources that tie in size over weight are filled in the order of their names; a null doc_id
is hashed as the word null, and repeated doc_ids draw alike; an empty table gives an empty one; other columns, whatever
their names, stay as they are in ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftsum.llm.text import WORD
from driftsum.session import materialize, table

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target, rate) from (source, size); one row for each source.

    In the order of limit / weight, the level of source i is what is left when all before it are at
    their limits, over the weights that are left. It rises while sources are full and falls after
    that, so the true level is the largest.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0))
    by = by.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - full) / (F.sum("weight").over(everything) - used))
    by = by.withColumn("level", F.max("level").over(everything))
    by = by.withColumn("target", F.least(F.col("source_size") * F.lit(float(limit)), F.col("weight") * F.col("level")))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(0.0)
    return by.select("source", "source_size", "target", rate.alias("rate"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, source, and no column named like those of the result) with source_size, target, rate and copies.

    No broadcast is forced: the number of sources is not bounded, so the planner chooses by size,
    and a hot source is split by the skew-join rule.
    """
    r = rates.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    out = docs.join(r, docs["source"].eqNullSafe(r["_source"]), "left").drop("_source")
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + (uniform(F.col("doc_id"), seed) < F.col("rate") - whole).cast("int")).cast("int"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    keys = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "doc_id", "source")
    out = with_copies(keys, source_rates(sized, weights, share, limit)).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    docs = table(spark, sf_dir, "documents")
    # the texts are read once; what follows needs three short columns
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mixing-sizes")
    out = with_copies(sized, source_rates(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it."""
    return mix_documents(docs)


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER)] AS weight FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(CAST(sum(source_size * 2) OVER p AS BIGINT), 0))
      / (CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER p AS BIGINT), 0)) AS level FROM w
      WINDOW p AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM t),
c AS (SELECT doc_id, size, source_size, target, rate,
      CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
