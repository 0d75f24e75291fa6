"""Connected components of an edge table by alternating star contraction.

Each round links every node's larger neighbours to its smallest one, then every node and its
smaller neighbours to the smallest of them; edges only move towards smaller nodes, and the
fixed point is a star around the smallest node of each component. Minima are pre-aggregated
before the shuffle; the join that follows is one the skew rule can split, so a node may have
any number of edges. Each round is written to the shared folder, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsum.session import materialize, release, splittable

ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Edges from a node to itself and edges with nulls are ignored; repeated edges count once. ``rows`` is a
    bound of the number of edges, if one is known.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "components", rows)
    state = _state(e)
    for _ in range(ROUNDS if state[0] else 0):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(splittable(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(splittable(least, "u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "components", state[0])
        release(e)
        e, before, state = new, state, _state(new)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError("components did not converge")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
