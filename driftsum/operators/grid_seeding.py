"""Approximate k-means++ on shifted grids.

A tree is a stack of grids with halved cells and one random shift; the distance of two points in it is set
by the deepest level on which they share a cell. Several trees are used and the smallest distance counts. Grids are
nested, so a point is its cells on the finest grids: where those of two points first differ, bit by bit, is
the level, and a point keeps one number, the smallest difference to any seed so far.

Seeds are drawn in rounds: proposals by the weights of the last round, each taken with the share of its weight that the
seeds since then have left. That is what drawing one seed after the other gives, with one pass over the
points for many seeds instead of one for each.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftsum.operators import small
from driftsum.operators.sampling import weighted_sample
from driftsum.session import materialize, release

TREES, LEVELS, PROPOSALS = 3, 40, 32
FAR = (1 << 62) - 1  # the difference to no seed at all


@dataclass(frozen=True)
class Grids:
    """shifts: for each tree and dimension; extent: level 0 is one cell of twice that; levels: of finer grids below it."""

    shifts: tuple[tuple[float, ...], ...]
    extent: float
    levels: int = LEVELS

    @property
    def dims(self) -> int:
        return len(self.shifts[0])

    def size(self) -> float:
        return 2.0 * self.extent / (1 << self.levels)

    def names(self) -> list[str]:
        return [f"cell_{t}_{i}" for t in range(len(self.shifts)) for i in range(self.dims)]

    def cells(self, coords: Column) -> list[Column]:
        """The cells of a point on the finest grids."""
        return [fine_cell(coords[i], s[i], self.extent, self.levels).alias(f"cell_{t}_{i}") for t, s in enumerate(self.shifts) for i in range(self.dims)]

    def cells_of(self, coords: list[float]) -> list[int]:
        return [floor((coords[i] + s[i]) / self.size()) for s in self.shifts for i in range(self.dims)]

    def difference(self, cells: list[int]) -> Column:
        """The difference between a row's cells and constant ones: the smallest of all trees."""
        trees = []
        for t in range(len(self.shifts)):
            differ = F.lit(0).cast("long")
            for i in range(self.dims):
                differ = differ.bitwiseOR(F.col(f"cell_{t}_{i}").bitwiseXOR(F.lit(cells[t * self.dims + i]).cast("long")))
            trees.append(differ)
        return F.least(*trees) if len(trees) > 1 else trees[0]

    def difference_of(self, a: list[int], b: list[int]) -> int:
        out = []
        for t in range(len(self.shifts)):
            differ = 0
            for i in range(t * self.dims, (t + 1) * self.dims):
                differ |= a[i] ^ b[i]
            out.append(differ)
        return min(out)

    def distance_of(self, difference: int) -> float:
        return _distance(self.levels - difference.bit_length() if difference.bit_length() <= self.levels else -1, self.extent, self.dims, self.levels)


def _distance(level: int, extent: float, dims: int, levels: int) -> float:
    return 2.0 * (2.0 * extent * dims**0.5) * (2.0**-level - 2.0**-levels)


def fine_cell(x: Column, shift: float, extent: float, levels: int) -> Column:
    """The cell of a coordinate on the finest grid; level 0 is one cell of 2 * extent around the shifted points."""
    return F.floor((x + F.lit(shift)) / F.lit(2.0 * extent / (1 << levels))).cast("long")


def level_of(difference: Column, levels: int) -> Column:
    """The deepest common level (0 to levels) of a difference; -1 if not even the first is."""
    bits = F.when(difference == 0, 0).otherwise(F.length(F.bin(difference)))
    return F.greatest(F.lit(levels) - bits, F.lit(-1))


def tree_distance(level: Column | int, extent: float, dims: int, levels: int = LEVELS) -> Column:
    """Twice the sum of the cell diagonals below the deepest common level (-1: twice the first cell's)."""
    level = F.lit(level) if isinstance(level, int) else level
    diagonal = 2.0 * extent * dims**0.5
    return 2.0 * diagonal * (F.pow(F.lit(2.0), -level) - F.lit(2.0**-levels))


def common_level(a: Column, b: Column, shift: list[float], extent: float, levels: int = LEVELS) -> Column:
    """The deepest level (0 to levels) on which a and b share a cell; -1 if not even on the first."""
    differ = F.lit(0).cast("long")
    for i, s in enumerate(shift):
        differ = differ.bitwiseOR(fine_cell(a[i], s, extent, levels).bitwiseXOR(fine_cell(b[i], s, extent, levels)))
    return level_of(differ, levels)


def grids_for(points: DataFrame, dims: int, seed: int, trees: int = TREES, levels: int = LEVELS) -> Grids:
    """Grids around all points, with shifts from hashes."""
    bounds = points.agg(*[F.max(F.abs(F.col("coords")[i])).alias(f"m{i}") for i in range(dims)]).first()
    extent = max([1e-9, *(2.0 * (b or 0.0) for b in bounds)])
    return Grids(tuple(tuple(small.uniform(seed, f"shift{t}", i) * extent + extent for i in range(dims)) for t in range(trees)), extent, levels)


@dataclass
class Seeding:
    """rows: (point_id, weight, coords, cells, near), near being the difference to the nearest seed; seeds: (point_id, coordinates)."""

    grids: Grids
    rows: DataFrame
    seeds: list[tuple[int, list[float]]]

    @classmethod
    def over(cls, points: DataFrame, grids: Grids, seeds: list[tuple[int, list[float]]] = ()) -> Seeding:
        rows = points.select("point_id", "weight", "coords", *grids.cells(F.col("coords"))).withColumn("near", F.lit(FAR))
        return cls(grids, rows, []).marked(list(seeds))

    def marked(self, seeds: list[tuple[int, list[float]]]) -> Seeding:
        """With more seeds: the nodes on their paths count as open, so every point's nearest is at least as near."""
        near = [self.grids.difference(self.grids.cells_of(c)) for _, c in seeds]
        rows = self.rows.withColumn("near", F.least("near", *near)) if near else self.rows
        return Seeding(self.grids, rows, [*self.seeds, *seeds])

    def insert(self, points: DataFrame) -> Seeding:
        """With more points, which are compared with the seeds; the others are not read."""
        new = Seeding.over(points, self.grids, self.seeds)
        return Seeding(self.grids, self.rows.unionAll(new.rows.select(self.rows.columns)), self.seeds)

    def remove(self, ids: DataFrame) -> Seeding:
        """Without the points ``ids`` (point_id). Seeds among them go too; then the rest is compared with those that stay."""
        gone = {r["point_id"] for r in ids.where(F.col("point_id").isin([key for key, _ in self.seeds])).distinct().collect()} if self.seeds else set()
        rows = self.rows.join(ids.select("point_id").distinct(), "point_id", "left_anti").select(self.rows.columns)
        if not gone:
            return Seeding(self.grids, rows, self.seeds)
        return Seeding(self.grids, rows.withColumn("near", F.lit(FAR)), []).marked([s for s in self.seeds if s[0] not in gone])

    def levels(self) -> Column:
        return level_of(F.col("near"), self.grids.levels)

    def weights(self) -> Column:
        """Weight times the squared distance to the nearest seed in the trees; the weight alone where there is no seed."""
        d = tree_distance(self.levels(), self.grids.extent, self.grids.dims, self.grids.levels)
        return F.col("weight") * d * d if self.seeds else F.col("weight")


def fast_seeds(points: DataFrame, k: int, dims: int, seed: int, trees: int = TREES, levels: int = LEVELS) -> list[tuple[int, list[float], int]]:
    """(number, coordinates, point_id) of k seeds: each drawn by weight times squared tree distance to the nearest seed; fewer if all points lie on seeds."""
    state, before, turn = Seeding.over(points, grids_for(points, dims, seed, trees, levels)), None, 0
    while len(state.seeds) < k:
        state = Seeding(state.grids, materialize(state.rows, "fast-seeding"), state.seeds)
        if before is not None:
            release(before)
        before = state.rows
        count = PROPOSALS if state.seeds else 1
        drawn = weighted_sample(state.rows, state.weights(), count, seed, f"fast{turn}").select("draw_no", "point_id", "coords", "near").collect()
        new = accepted(state.grids, sorted((r["draw_no"], r["point_id"], list(r["coords"]), r["near"]) for r in drawn), seed, turn, bool(state.seeds))[: k - len(state.seeds)]
        if not new:
            break
        state, turn = state.marked(new), turn + 1
    if before is not None:
        release(before)
    return [(n, c, key) for n, (key, c) in enumerate(state.seeds)]


def accepted(grids: Grids, proposals: list[tuple[int, int, list[float], int]], seed: int, turn: int, any_before: bool) -> list[tuple[int, list[float]]]:
    """The seeds among proposals (draw_no, point_id, coordinates, near), one after the other."""
    out: list[tuple[int, list[float]]] = []
    for n, key, coords, near in proposals:
        if any_before:
            now = min([near, *(grids.difference_of(grids.cells_of(coords), grids.cells_of(c)) for _, c in out)])
            if now != near and small.uniform(seed, f"accept{turn}", n) >= (grids.distance_of(now) / grids.distance_of(near)) ** 2:
                continue
        out.append((key, coords))
    return out
