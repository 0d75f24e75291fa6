"""k-means++ seeding, Lloyd iterations and their costs.

Each round is one or two jobs over the points with the centres so far as constants in the
expressions, so no state is carried from round to round and no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftsum.functions.geometry import nearest
from driftsum.operators.clustering import Centres, assign
from driftsum.operators.sampling import pick
from driftsum.session import materialize, release

ROUNDS, TOLERANCE = 300, 1e-4


def _u(spark, seed: int, step: int) -> float:
    from driftsum.functions.rng import uniform

    return spark.range(1).select(uniform(seed, "seed", F.lit(step))).first()[0]


#: Centres after which the distance to the nearest one is written as a column, so that no expression holds more.
REFRESH = 16


def seed_centres(points: DataFrame, k: int, seed: int) -> list[tuple[int, list[float], int]]:
    """(number, coordinates, point_id) of up to k centres in the order of choice.

    The first is drawn by weight, each next by weight times squared distance to the nearest so far. Fewer
    than k come back if all points lie on the chosen ones.
    """
    out: list[tuple[int, list[float], int]] = []
    rows, since = points.select("point_id", "weight", "coords"), 0  # centres from ``since`` on are not in column d2
    for step in range(k):
        if step - since >= REFRESH:
            before = rows
            rows = materialize(rows.select("point_id", "weight", "coords", _nearest_of(out[since:], since > 0).alias("d2")), "seeding")
            release(before)
            since = step
        weight = F.col("weight") if not out else F.col("weight") * _nearest_of(out[since:], since > 0)
        key = pick(rows, weight, _u(points.sparkSession, seed, step))
        if key is None:
            break
        row = rows.where(F.col("point_id") == key).select("coords").first()
        out.append((step, list(row["coords"]), key))
    release(rows)
    return out


def _nearest_of(centres: list[tuple[int, list[float], int]], known: bool) -> Column:
    """The squared distance to the nearest of ``centres`` and, if ``known``, of those before, whose is in column d2."""
    new = nearest(F.col("coords"), [(i, c) for i, c, _ in centres])["d2"] if centres else None
    return F.col("d2") if new is None else F.least(F.col("d2"), new) if known else new


def ordered_by_id(centres: list[tuple[int, list[float], int]]) -> list[tuple[int, list[float]]]:
    """Centres renumbered by ascending point id."""
    return [(n, c) for n, (_, c, _) in enumerate(sorted(centres, key=lambda x: x[2]))]


def lloyd_step(points: DataFrame, centres: Centres) -> list[tuple[int, list[float]]]:
    """Weighted means of the clusters; a centre without any weight stays where it is."""
    dims = len(centres[0][1])
    sums = [F.sum(F.col("weight") * F.col("coords")[i]).alias(f"s{i}") for i in range(dims)]
    rows = assign(points, centres).groupBy("cluster_id").agg(F.sum("weight").alias("w"), *sums).collect()
    by = {r["cluster_id"]: [r[f"s{i}"] / r["w"] for i in range(dims)] for r in rows if r["w"] and r["w"] > 0}
    return [(i, by.get(i, list(c))) for i, c in centres]


def lloyd(points: DataFrame, centres: Centres, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[tuple[int, list[float]]]:
    """Up to ``rounds`` steps, until the norm of the centres' move is below ``tolerance``."""
    centres = [(i, list(c)) for i, c in centres]
    if not centres:
        return []
    for _ in range(rounds):
        new = lloyd_step(points, centres)
        moved = sum((a - b) ** 2 for (_, x), (_, y) in zip(new, centres, strict=True) for a, b in zip(x, y, strict=True)) ** 0.5
        centres = new
        if moved < tolerance:
            break
    return centres


def kmeans(points: DataFrame, k: int, seed: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[tuple[int, list[float]]]:
    """The solution on a table of any size; ``operators.small.kmeans`` gives the same on a bounded one."""
    return lloyd(points, ordered_by_id(seed_centres(points, k, seed)), rounds, tolerance)


def sq_cost(points: DataFrame, centres: Centres) -> tuple[float, float]:
    """(sum of weight times squared distance, sum of weights)."""
    row = assign(points, centres).agg(F.sum(F.col("weight") * F.col("d2")), F.sum("weight")).first()
    return row[0] or 0.0, row[1] or 0.0


def centres_frame(spark, centres: Centres) -> DataFrame:
    """(cluster_id, c0, c1, ...) of constant centres."""
    rows = F.array(*[F.struct(F.lit(int(i)).alias("cluster_id"), *[F.lit(float(x)).alias(f"c{j}") for j, x in enumerate(c)]) for i, c in centres])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")
