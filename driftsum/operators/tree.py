"""Merge-and-reduce trees of summaries, binary or of fixed height.

A tree is a table of rows (level, node_id, point_id, is_center, w_milli, coords), leaves at level 0; the parent of a
node is node_id div fan_in. Weights are whole thousandths, so sums over a tree are exact. A node is the
union of its children while that has at most ``cutoff`` rows, else it is reduced by sensitivity
sampling to ``size`` rows.

Levels are computed in bands: one grouped call takes all rows below a node of the band's upper edge, about
``BAND_ROWS`` at most, and makes every level of the band, so a tree over billions of points is a handful of jobs.
A change sends only the changed nodes, their siblings and their ancestors through these calls.

Trees of at most ``MEMORY_ROWS`` points are changed in memory, by the same rules and with the same result: many small jobs
would cost more than the work. Leaves of larger ones are tables too: their sizes and the few numbers that decide where points go are counted by the cluster,
and only single numbers come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftsum.operators.generators import numbered
from driftsum.operators.small import in_bucket_order, reduce_rows
from driftsum.session import materialize

ROWS = "level int, node_id long, point_id long, is_center boolean, w_milli long, coords array<double>"
NAMES = ["level", "node_id", "point_id", "is_center", "w_milli", "coords"]
#: With ``fresh``: rows that a batch appends; rows without a point are markers of changed nodes (fresh: by appends alone).
CHANGES = ROWS + ", fresh boolean"
BAND_ROWS = 1 << 16
MEMORY_ROWS = 100_000


@dataclass(frozen=True)
class Shape:
    """k: centres of a reduction; size: rows after it; cutoff: rows up to which a union is kept; leaf: points of a full leaf.

    ``insertion``: rows up to which appended points go straight into the nodes above, without a reduction.
    ``height``: levels of a fixed-height tree, root and leaves included; its root takes any number of children.
    """

    k: int = 3
    size: int = 40
    cutoff: int = 40
    leaf: int = 50
    fan_in: int = 2
    height: int | None = None
    seed: int = 7
    insertion: int = 0

    def fan(self, level: int) -> int:
        """Children of a node of ``level``."""
        return self.fan_in if self.height is None or level < self.height - 1 else 1 << 62


@dataclass
class Tree:
    """rows: all levels; leaves: their number; open: the leaf that takes points next; points: rows of the leaves, if known; height: levels above the leaves."""

    rows: DataFrame
    shape: Shape
    leaves: int
    open: int | None = None
    points: int | None = None

    @property
    def height(self) -> int:
        return height_of(self.leaves, self.shape)

    def level(self, level: int) -> DataFrame:
        return self.rows.where(F.col("level") == level)


def height_of(n_leaves: int, shape: Shape) -> int:
    """Levels above the leaves."""
    if shape.height is not None:
        return shape.height - 1
    out, reach = 0, 1
    while reach < n_leaves:
        out, reach = out + 1, reach * shape.fan_in
    return out


def bands(leaves: int, shape: Shape) -> list[tuple[int, int]]:
    """(lower, upper) levels: what lies below a node of the upper one is about BAND_ROWS rows, or one level."""
    out, low, height = [], 0, height_of(leaves, shape)
    leaf = leaf_capacity(leaves, shape.leaf_factor) if isinstance(shape, FlatShape) else shape.leaf
    while low < height:
        high, rows = low + 1, max(leaf if low == 0 else 0, shape.cutoff) * shape.fan(low + 1)
        while high < height and rows * shape.fan(high + 1) <= BAND_ROWS:
            high, rows = high + 1, rows * shape.fan(high + 1)
        out.append((low, high))
        low = high
    return out


def _reduced(rows: tuple, shape: Shape, cutoff: int, level: int, node: int) -> tuple:
    """(ids, is_center, milli, coords) of a node from the union of its children."""
    return rows if len(rows[0]) <= cutoff else reduce_rows(rows[0], rows[2], rows[3], shape.k, shape.size, shape.seed, f"{level}:{node}")


def _joined(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _band(shape: Shape, low: int, high: int):
    """A grouped function: changed nodes of the levels above ``low`` up to ``high``, from the rows below one node of ``high``."""

    def run(group: pa.Table) -> pa.Table:
        level, node = (group.column(c).to_numpy() for c in ("level", "node_id"))
        marker = group.column("point_id").is_null().to_numpy()
        fresh = group.column("fresh").to_numpy().astype(bool)
        ids, milli = (group.column(c).fill_null(0).to_numpy() for c in ("point_id", "w_milli"))
        centre = group.column("is_center").fill_null(False).to_numpy().astype(bool)
        coords = group.column("coords").combine_chunks().flatten().to_numpy()
        at = np.cumsum(~marker) - 1  # the place of a row's coordinates
        coords = coords.reshape(int((~marker).sum()), -1) if len(coords) else np.empty((0, 1))
        dirty = {int(n): bool(f) for n, f in zip(node[marker], fresh[marker], strict=True)}  # changed by appends alone?

        def take(x: np.ndarray) -> tuple:
            return ids[x], centre[x], milli[x], coords[at[x]]

        order = np.lexsort((node, level))
        order = order[~marker[order]]
        edges = np.flatnonzero(np.diff(level[order], prepend=-1) | np.diff(node[order], prepend=-1)) if len(order) else np.empty(0, np.int64)
        nodes: dict[int, dict[int, tuple]] = {}
        for x in np.split(order, edges[1:]) if len(order) else ():
            nodes.setdefault(int(level[x[0]]), {})[int(node[x[0]])] = x
        appended = {n: x[fresh[x]] for n, x in nodes.get(low, {}).items() if dirty.get(n)}
        added = {n: take(x) for n, x in appended.items()}
        rows = {lev: {n: take(x) for n, x in by.items()} for lev, by in nodes.items()}
        flat = shape.height is not None
        out: list[tuple[int, int, tuple, np.ndarray]] = []
        for lev in range(low + 1, high + 1):
            fan = shape.fan(lev)
            children: dict[int, list[int]] = {}
            for n in sorted(rows.get(lev - 1, {})):
                children.setdefault(n // fan, []).append(n)
            above, fresh_above, here = {}, {}, rows.setdefault(lev, {})
            under: dict[int, list[int]] = {}
            for n in sorted(dirty):
                under.setdefault(n // fan, []).append(n)
            for parent, changed in under.items():
                new = [added[n] for n in changed if n in added]
                before = here.get(parent)
                if all(dirty[n] for n in changed) and new and before is not None and len(before[0]) + sum(len(x[0]) for x in new) <= shape.insertion:
                    here[parent], fresh_above[parent], above[parent] = _joined([before, *new]), _joined(new), True
                else:
                    below = [rows[lev - 1][n] for n in children.get(parent, [])]
                    if flat and lev == 1:  # large leaves count by their reductions
                        below = [_reduced(x, shape, shape.cutoff, 0, n) for x, n in zip(below, children.get(parent, []), strict=True)]
                    above[parent] = False
                    if below:
                        here[parent] = _reduced(_joined(below), shape, shape.cutoff, lev, parent)
                    else:
                        here.pop(parent, None)
                if parent in here:
                    n, tail = len(here[parent][0]), len(fresh_above[parent][0]) if above[parent] else 0
                    out.append((lev, parent, here[parent], np.arange(n) >= n - tail))
            out += [(lev, n, None, np.array([soft])) for n, soft in above.items()]
            dirty, added = above, fresh_above
        real = [x for x in out if x[2] is not None]
        out = real + [x for x in out if x[2] is None]
        sizes = [1 if x[2] is None else len(x[2][0]) for x in out]
        n_real = sum(sizes[: len(real)])
        ids, centre, milli, coords = _joined([x[2] for x in real]) if real else (np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty((0, 1)))
        blank = sum(sizes) - n_real
        none = np.concatenate([np.zeros(n_real, bool), np.ones(blank, bool)])
        filled = lambda x, v: pa.array(np.concatenate([x, np.full(blank, v, x.dtype)]), mask=none)
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(n_real + 1), np.full(blank, n_real)) * coords.shape[1], pa.int32()), pa.array(coords.ravel()))
        return pa.table({
            "level": pa.array(np.repeat(np.array([x[0] for x in out], np.int32), sizes)), "node_id": pa.array(np.repeat(np.array([x[1] for x in out], np.int64), sizes)),
            "point_id": filled(ids.astype(np.int64), 0), "is_center": filled(centre, False), "w_milli": filled(milli.astype(np.int64), 0), "coords": lists,
            "fresh": pa.array(np.concatenate([x[3] for x in out]) if out else np.empty(0, bool)),
        })

    return run


def _up(column, shape: Shape, low: int, high: int):
    """The ancestor in level ``high`` of a node of level ``low``."""
    for level in range(low + 1, high + 1):
        column = F.floor(column / shape.fan(level)).cast("long")
    return column


def _in_memory(rows: DataFrame | None, changed: DataFrame, leaves: int, shape: Shape) -> DataFrame:
    """:func:`changes` as a single call over all rows."""
    table, height = changed.select(*NAMES, "fresh").toArrow(), height_of(leaves, shape)
    if not height:
        return changed
    send = [table]
    if rows is not None:
        marks = table.filter(table.column("point_id").is_null()).column("node_id").to_numpy()
        old = rows.where(F.col("level") <= height).select(*NAMES, F.lit(False).alias("fresh")).toArrow()
        keep = (old.column("level").to_numpy() > 0) | ~np.isin(old.column("node_id").to_numpy(), marks)
        send.append(old.filter(pa.array(keep)).cast(table.schema))
    return changed.sparkSession.createDataFrame(_band(shape, 0, height)(pa.concat_tables(send)), CHANGES).unionAll(changed.select(*NAMES, "fresh"))


def changes(rows: DataFrame | None, changed: DataFrame, leaves: int, shape: Shape, points: int | None = None) -> DataFrame:
    """All changed nodes of a tree with ``leaves`` leaves, in the layout of CHANGES: their new rows, and a marker for each.

    ``changed`` has the same layout and holds level 0: all rows of each changed leaf, and a marker, also where
    none are left. ``rows`` is the tree before (null: there was none), ``points`` the number of points before and after, if known.
    """
    if points is not None and points <= MEMORY_ROWS:
        return _in_memory(rows, changed, leaves, shape)
    out = [materialize(changed, "tree")]
    for low, high in bands(leaves, shape):
        below = out[-1].where(F.col("level") == low).withColumn("group", _up(F.col("node_id"), shape, low, high))
        send = [below]
        if rows is not None:
            marks = below.where("point_id is null")
            parents = marks.select(_up(F.col("node_id"), shape, low, low + 1).alias("_parent")).distinct()
            groups = marks.select("group").distinct()
            here = rows.where(F.col("level") == low).join(marks.select("node_id"), "node_id", "left_anti").withColumn("_parent", _up(F.col("node_id"), shape, low, low + 1))
            send.append(here.join(parents, "_parent", "left_semi").withColumns({"fresh": F.lit(False), "group": _up(F.col("node_id"), shape, low, high)}))
            for level in range(low + 1, high + 1 if shape.insertion else high):
                here = rows.where(F.col("level") == level).withColumns({"fresh": F.lit(False), "group": _up(F.col("node_id"), shape, level, high)})
                send.append(here.join(groups, "group", "left_semi"))
        columns = ["group", *NAMES, "fresh"]
        together = reduce(DataFrame.unionAll, [x.select(*columns) for x in send])
        out.append(materialize(together.groupBy("group").applyInArrow(_band(shape, low, high), CHANGES), "tree"))
    return reduce(DataFrame.unionAll, out)


def marked(leaf_rows: DataFrame, nodes: DataFrame | None = None, appended: DataFrame | None = None) -> DataFrame:
    """``changed`` for :func:`changes`: rows of whole leaves with ``fresh``, and markers for their nodes and for ``nodes`` (node_id).

    ``appended`` (node_id) are leaves that were only appended to.
    """
    ids = leaf_rows.select("node_id")
    ids = (ids if nodes is None else ids.unionAll(nodes.select("node_id"))).distinct()
    soft = ids.withColumn("fresh", F.lit(False)) if appended is None else ids.join(appended.select("node_id", F.lit(True).alias("fresh")), "node_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("point_id", "long"), ("is_center", "boolean"), ("w_milli", "long"), ("coords", "array<double>"))]
    return leaf_rows.select(*NAMES, "fresh").unionAll(soft.select(F.lit(0).alias("level"), "node_id", *none, "fresh"))


def applied(rows: DataFrame, delta: DataFrame) -> DataFrame:
    """The tree's rows with those of changed nodes replaced."""
    marks = delta.where("point_id is null").select("level", "node_id")
    return rows.join(marks, ["level", "node_id"], "left_anti").select(*NAMES).unionAll(delta.where("point_id is not null").select(*NAMES))


def _leaf_rows(points: DataFrame, node) -> DataFrame:
    return points.select(F.lit(0).alias("level"), node.alias("node_id"), "point_id", F.lit(False).alias("is_center"), F.floor(F.col("weight") * 1000).cast("long").alias("w_milli"), "coords")


def leaves(points: DataFrame, shape: Shape) -> DataFrame:
    """Level 0 of a new tree: points in (bucket, id) order, ``leaf`` to a node."""
    return _leaf_rows(numbered(points), F.floor(F.col("at") / shape.leaf).cast("long"))


def build(points: DataFrame, shape: Shape) -> Tree:
    """A new tree; the last leaf is open unless it is full."""
    rows = materialize(leaves(points, shape), "tree")
    out = over(rows, shape)
    return Tree(out.rows, shape, leaf_count(out.points, shape.leaf_factor), None, out.points) if isinstance(shape, FlatShape) else out


def over(leaf_rows: DataFrame, shape: Shape) -> Tree:
    """The tree over given leaves, all of whose levels are computed; the leaf with the last number is open unless it is full."""
    found = leaf_rows.groupBy("node_id").count().agg(F.max(F.struct("node_id", "count")).alias("x"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()
    last, points = found["x"], found["n"]
    count = 0 if last is None else last["node_id"] + 1
    delta = changes(None, marked(leaf_rows.withColumn("fresh", F.lit(False))), count, shape, points)
    return Tree(delta.where("point_id is not null").select(*NAMES), shape, count, None if last is None or last["count"] >= shape.leaf else last["node_id"], points)


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.where("level = 0").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


def update(tree: Tree, inserted: DataFrame | None, deleted: DataFrame | None, shape: Shape | None = None, refresh: DataFrame | None = None) -> tuple[DataFrame, int, int | None]:
    """(changes of level 0, leaves, open leaf) after points are deleted (point_id) and inserted (point_id, weight, coords).

    Binary trees: points go to the open leaf until it is full, then to new leaves. Leaves that deletes leave with fewer
    than ``leaf`` points are dissolved into the open one (without an open one the first of them becomes it), and the last leaves take
    the numbers that get free. A new ``shape`` dissolves leaves that are too small for it, and those of more than twice its size.
    Fixed-height trees: the capacity of a leaf follows the number of leaves, which grows with inserts and shrinks when one
    leaf less would do; then the last leaves, and what is above the new capacity, are dealt to the others.
    ``refresh`` (node_id) are leaves to recompute although they did not change.
    """
    spark, shape = tree.rows.sparkSession, shape or tree.shape
    leaf0 = tree.level(0).select(*NAMES)
    none = spark.createDataFrame([], "point_id long, weight double, coords array<double>")
    inserted = none if inserted is None else inserted.select("point_id", "weight", "coords")
    if tree.points is not None and tree.points <= MEMORY_ROWS and shape.height is None:
        new = _leaf_rows(inserted, F.lit(0).cast("long")).limit(MEMORY_ROWS + 1).toArrow()
        if new.num_rows <= MEMORY_ROWS:
            ids = lambda df, name: np.empty(0, np.int64) if df is None else df.select(name).distinct().toArrow().column(name).to_numpy()
            level0, count, open_ = _update_in_memory(tree, shape, leaf0.toArrow(), new, ids(deleted, "point_id"), ids(refresh, "node_id"))
            return spark.createDataFrame(level0, CHANGES), count, open_
    touched, kept = spark.createDataFrame([], "node_id long"), leaf0
    if deleted is not None:
        gone = deleted.select("point_id").distinct()
        touched = materialize(leaf0.join(gone, "point_id", "left_semi").select("node_id").distinct(), "tree-touched")
        kept = leaf0.join(gone, "point_id", "left_anti").select(*NAMES)
    sizes = _sizes(leaf0).select("node_id").join(_sizes(kept), "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = materialize(sizes, "tree-sizes")
    run = _update_binary if shape.height is None else _update_flat
    return run(tree, shape, kept, sizes, touched, materialize(inserted, "tree-inserted"), refresh)


def _dealt(rows: DataFrame, node) -> DataFrame:
    """Rows (point_id, w_milli, coords) as new rows of leaves."""
    return rows.select(F.lit(0).alias("level"), node.alias("node_id"), "point_id", F.lit(False).alias("is_center"), "w_milli", "coords", F.lit(True).alias("fresh"))


def _update_in_memory(tree: Tree, shape: Shape, old: pa.Table, new: pa.Table, gone: np.ndarray, refresh: np.ndarray) -> tuple[pa.Table, int, int | None]:
    """_update_binary() on arrays."""
    leaf, before = shape.leaf, tree.shape.leaf
    column = lambda t, c: t.column(c).to_numpy()
    node, ids = column(old, "node_id"), column(old, "point_id")
    lost = np.isin(ids, gone)
    touched, leaves_ = np.unique(node[lost]), np.unique(node)
    n = np.bincount(np.searchsorted(leaves_, node[~lost]), minlength=len(leaves_)) if len(leaves_) else np.empty(0, np.int64)
    short = (n == 0) | ((n < leaf) & (np.isin(leaves_, touched) | (leaf != before))) | ((n > 2 * leaf) & (leaf < before))
    size_of = dict(zip(leaves_.tolist(), n.tolist(), strict=True))
    current, n_open = tree.open, size_of.get(tree.open, 0)
    if n_open == 0 or n_open >= leaf:
        first = leaves_[short & (n > 0) & (n < leaf)]
        current = int(first[0]) if len(first) else None
        n_open = size_of.get(current, 0)
    holes = leaves_[short & (leaves_ != (-1 if current is None else current))]
    holes = holes[in_bucket_order(holes)]
    stays = ~lost & ~np.isin(node, holes)
    moved_out = np.flatnonzero(~lost & np.isin(node, holes))
    stream = pa.concat_tables([old.take(moved_out), new.cast(old.schema)])
    stream = stream.take(in_bucket_order(column(stream, "point_id")))
    m, h, room = stream.num_rows, len(holes), leaf - n_open if current is not None else 0
    slots = -(-max(0, m - room) // leaf)
    slot = (np.arange(m) - room) // leaf
    dealt = np.where(slot >= h, tree.leaves - h + slot, np.append(holes, 0)[np.clip(slot, 0, h)])
    dealt = np.where(slot < 0, -1 if current is None else current, dealt)
    count = tree.leaves + slots - h
    free = holes[slots:]
    last = leaves_[(leaves_ >= count) & ~np.isin(leaves_, free)]
    moves = dict(zip(last[in_bucket_order(last)].tolist(), free[free < count].tolist(), strict=True))
    stay = np.setdiff1d(np.concatenate([touched, refresh, dealt]), holes)
    at = np.flatnonzero(stays & np.isin(node, np.concatenate([stay, last])))
    number = lambda x: np.array([moves.get(i, i) for i in x.tolist()], np.int64)
    rows = pa.concat_tables([old.take(at), stream])
    nodes = np.concatenate([number(node[at]), number(dealt)])
    fresh = np.repeat([False, True], [len(at), m])
    hard = np.unique(np.concatenate([touched, holes, leaves_[leaves_ >= count], np.array([*moves.values()], np.int64), np.intersect1d(refresh, leaves_)]).astype(np.int64))
    marks = np.union1d(nodes, hard).astype(np.int64)
    if m > room or current is None:
        rest = max(0, m - room) % leaf
        current = None if not rest else count - 1 if slots > h else int(holes[slots - 1])
    elif m == room:
        current = None
    blank = len(marks)
    level0 = pa.table({
        "level": pa.array(np.zeros(len(nodes) + blank, np.int32)), "node_id": pa.array(np.concatenate([nodes, marks])),
        "point_id": pa.concat_arrays([rows.column("point_id").combine_chunks(), pa.nulls(blank, pa.int64())]), "is_center": pa.concat_arrays([pa.array(np.zeros(len(nodes), bool)), pa.nulls(blank, pa.bool_())]),
        "w_milli": pa.concat_arrays([rows.column("w_milli").combine_chunks(), pa.nulls(blank, pa.int64())]), "coords": pa.concat_arrays([rows.column("coords").combine_chunks(), pa.nulls(blank, old.schema.field("coords").type)]),
        "fresh": pa.array(np.concatenate([fresh, ~np.isin(marks, hard)])),
    })
    return level0, count, moves.get(current, current)


def _update_binary(tree: Tree, shape: Shape, kept: DataFrame, sizes: DataFrame, touched: DataFrame, inserted: DataFrame, refresh: DataFrame | None) -> tuple[DataFrame, int, int | None]:
    few = sizes.where((F.col("n") == 0) | ((F.col("n") < shape.leaf) & (F.lit(shape.leaf != tree.shape.leaf)))).select("node_id", "n")
    short = sizes.join(touched, "node_id", "left_semi").where(F.col("n") < shape.leaf).unionAll(few)
    if shape.leaf < tree.shape.leaf:
        short = short.unionAll(sizes.where(F.col("n") > 2 * shape.leaf))
    short = short.distinct()
    current = tree.open
    n_open = 0
    if current is not None:
        row = sizes.where(F.col("node_id") == current).first()
        n_open = row["n"] if row else 0
        if n_open == 0 or n_open >= shape.leaf:  # empty, or full under a new shape
            current, n_open = None, 0
    if current is None:
        row = short.where((F.col("n") > 0) & (F.col("n") < shape.leaf)).agg(F.min(F.struct("node_id", "n")).alias("x")).first()["x"]
        if row is not None:
            current, n_open = row["node_id"], row["n"]
    holes = short.select("node_id") if current is None else short.where(F.col("node_id") != current).select("node_id")
    holes = materialize(numbered(holes, "node_id").select("node_id", F.col("at").alias("slot")), "tree-holes")
    displaced = kept.join(holes.select("node_id"), "node_id", "left_semi").select("point_id", "w_milli", "coords")
    stream = materialize(numbered(displaced.unionAll(_leaf_rows(inserted, F.lit(0)).select("point_id", "w_milli", "coords"))), "tree-stream")
    m, h, room = stream.count(), holes.count(), shape.leaf - n_open if current is not None else 0
    slots = -(-max(0, m - room) // shape.leaf)
    slot = F.floor((F.col("at") - room) / shape.leaf).cast("long")
    dealt = stream.withColumn("slot", slot).join(holes.withColumnRenamed("node_id", "hole"), "slot", "left")
    node = F.when(F.col("slot") >= h, F.lit(tree.leaves - h) + F.col("slot")).otherwise(F.col("hole"))
    node = node if current is None else F.when(F.col("at") < room, F.lit(current)).otherwise(node)
    dealt = _dealt(dealt, node.cast("long"))
    count = tree.leaves + slots - h
    # numbers that stay free go to the last leaves
    free = holes.where(F.col("slot") >= slots).select("node_id")
    last = sizes.where(F.col("node_id") >= count).select("node_id").join(holes.where(F.col("slot") >= slots).select("node_id"), "node_id", "left_anti")
    to = numbered(free.where(F.col("node_id") < count), "node_id").select(F.col("node_id").alias("to"), "at")
    moves = materialize(numbered(last, "node_id").select("node_id", "at").join(to, "at").select("node_id", "to"), "tree-moves")
    vanish = sizes.where(F.col("node_id") >= count).select("node_id")
    # the rows of all changed leaves, under their new numbers
    stay = touched if refresh is None else touched.unionAll(refresh.select("node_id"))
    target = dealt.select("node_id").distinct()
    stay = stay.unionAll(target).distinct().join(holes.select("node_id"), "node_id", "left_anti")
    old = kept.join(holes.select("node_id"), "node_id", "left_anti").join(moves, "node_id", "left")
    old = old.where("to is not null").unionAll(old.where("to is null").join(stay, "node_id", "left_semi").select(old.columns))
    old = old.withColumn("node_id", F.coalesce("to", "node_id")).withColumn("fresh", F.lit(False)).select(*NAMES, "fresh")
    renamed = dealt.join(moves, "node_id", "left").withColumn("node_id", F.coalesce("to", "node_id")).select(*NAMES, "fresh")
    rows = old.unionAll(renamed)
    dirty = touched.unionAll(holes.select("node_id")).unionAll(vanish).unionAll(moves.select(F.col("to").alias("node_id")))
    dirty = dirty if refresh is None else dirty.unionAll(refresh.select("node_id").join(sizes, "node_id", "left_semi"))
    hard = dirty.distinct()
    appended = rows.select("node_id").distinct().join(hard, "node_id", "left_anti")
    if m > room or current is None:  # the last slot is open unless it is full
        rest = max(0, m - room) % shape.leaf
        last_slot = holes.where(F.col("slot") == slots - 1).first() if rest and slots <= h else None
        current = None if not rest else count - 1 if last_slot is None else last_slot["node_id"]
    elif m == room:
        current = None
    moved = moves.where(F.col("node_id") == current).first() if current is not None else None
    if moved is not None:
        current = moved["to"]
    return marked(rows, hard, appended), count, current


def _update_flat(tree: Tree, shape: Shape, kept: DataFrame, sizes: DataFrame, touched: DataFrame, new: DataFrame, refresh: DataFrame | None) -> tuple[DataFrame, int, int | None]:
    factor = shape.leaf_factor if isinstance(shape, FlatShape) else 1.0
    n = (sizes.agg(F.sum("n")).first()[0] or 0) + new.count()
    count = max(1, tree.leaves)
    while count > 1 and n < (count - 1) * leaf_capacity(count - 1, factor):
        count -= 1
    while n > count * leaf_capacity(count, factor):
        count += 1
    capacity, shrinks = leaf_capacity(count, factor), count < tree.leaves
    place = F.row_number().over(Window.partitionBy("node_id").orderBy("point_id"))
    over_ = kept.withColumn("_n", place)
    above = (F.col("node_id") >= count) | (F.col("_n") > capacity)
    displaced = over_.where(above).select("point_id", "w_milli", "coords")
    stream = materialize(numbered(displaced.unionAll(_leaf_rows(new, F.lit(0)).select("point_id", "w_milli", "coords"))), "tree-stream")
    m = stream.count()
    spark = kept.sparkSession
    ids = spark.range(count).withColumnRenamed("id", "node_id")
    rooms = ids.join(sizes, "node_id", "left").select("node_id", (F.lit(capacity) - F.least(F.coalesce("n", F.lit(0)), F.lit(capacity))).alias("room"))
    before = Window.orderBy(F.desc("node_id")).rowsBetween(Window.unboundedPreceding, -1)  # from the right; one row for each leaf
    rooms = rooms.withColumn("start", F.coalesce(F.sum("room").over(before), F.lit(0))).where((F.col("room") > 0) & (F.col("start") < m))
    places = rooms.select("node_id", F.explode(F.sequence("start", F.least(F.col("start") + F.col("room"), F.lit(m)) - 1)).alias("at"))
    dealt = _dealt(stream.join(places, "at"), F.col("node_id"))
    dirty = touched.unionAll(dealt.select("node_id")).unionAll(over_.where(above).select("node_id"))
    if refresh is not None:
        dirty = dirty.unionAll(refresh.select("node_id"))
    if shrinks:  # every leaf is recomputed
        dirty = sizes.select("node_id").unionAll(dealt.select("node_id"))
    dirty = materialize(dirty.distinct(), "tree-dirty")
    old = over_.where(~above).join(dirty, "node_id", "left_semi").withColumn("fresh", F.lit(False)).select(*NAMES, "fresh")
    rows = old.unionAll(dealt.select(*NAMES, "fresh"))
    return marked(rows, dirty), count, None


def _changed(tree: Tree, level0: DataFrame, count: int, open_: int | None, shape: Shape) -> Tree:
    """The tree after ``level0`` changed; a tree that got lower loses its upper levels."""
    delta = changes(tree.rows, level0, count, shape, tree.points)
    rows = materialize(applied(tree.rows, delta).where(F.col("level") <= height_of(count, shape)), "tree")
    return Tree(rows, shape, count, open_, rows.where("level = 0").count())


def insert(tree: Tree, points: DataFrame) -> Tree:
    """The tree with more points (point_id, weight, coords)."""
    return _changed(tree, *update(tree, points, None), tree.shape)


def delete(tree: Tree, ids: DataFrame) -> Tree:
    """The tree without the points ``ids`` (point_id)."""
    return _changed(tree, *update(tree, None, ids), tree.shape)


def rebalance(tree: Tree, shape: Shape) -> Tree:
    """The tree under another shape: leaves that are too small or too large for it are dealt anew, and every node is computed."""
    level0, count, open_ = update(tree, None, None, shape)
    leaf = materialize(applied(tree.level(0), level0), "tree")
    out = over(leaf, shape)
    return Tree(out.rows, shape, count, open_, out.points)


def outer(root: DataFrame, shape: Shape, height: int) -> DataFrame:
    """(point_id, is_center, weight, coords): the summary of the whole tree: the root's rows, reduced once more if they are more than ``size``, or ``insertion`` if that is larger."""
    most = max(shape.size, shape.insertion)

    def run(group: pa.Table) -> pa.Table:
        coords = group.column("coords").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        ids, centre, milli = (group.column(c).to_numpy() for c in ("point_id", "is_center", "w_milli"))
        if len(ids) > most:
            ids, centre, milli, coords = reduce_rows(ids, milli, coords, shape.k, shape.size, shape.seed, f"{height + 1}:0")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * coords.shape[1], pa.int32()), pa.array(coords.ravel()))
        return pa.table({"point_id": pa.array(ids.astype(np.int64)), "is_center": pa.array(centre.astype(bool)), "w_milli": pa.array(milli.astype(np.int64)), "coords": lists})

    rows = root.select("point_id", "is_center", "w_milli", "coords").groupBy().applyInArrow(run, "point_id long, is_center boolean, w_milli long, coords array<double>")
    return rows.select("point_id", "is_center", (F.col("w_milli") / 1000).alias("weight"), "coords")


def summary(tree: Tree) -> DataFrame:
    return outer(tree.level(tree.height), tree.shape, tree.height)


def shape_of(rows: DataFrame) -> DataFrame:
    """(level, node_id, n, w_milli) of every node."""
    return rows.groupBy("level", "node_id").agg(F.count(F.lit(1)).alias("n"), F.sum("w_milli").alias("w_milli"))


def leaf_capacity(leaf_count: int, factor: float) -> int:
    return 1 if leaf_count == 1 else max(1, int(leaf_count * factor))


def leaf_count(n: int, factor: float) -> int:
    """The smallest number of leaves whose joint capacity takes n points: a search between powers of two, since the capacity rises."""
    low, high = 1, 1
    while high * leaf_capacity(high, factor) < n:
        low, high = high, high * 2
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if middle * leaf_capacity(middle, factor) >= n else (middle + 1, high)
    return low


@dataclass(frozen=True)
class FlatShape(Shape):
    """A fixed-height tree: ``leaf_factor`` times the number of leaves is a leaf's capacity."""

    leaf_factor: float = 1.0


def flat_shape(n: int, height: int, arity: int, factor: float = 1.0, **more) -> FlatShape:
    """A fixed-height tree for n points: the capacity of a leaf grows with the number of leaves."""
    return FlatShape(leaf=leaf_capacity(leaf_count(n, factor), factor), fan_in=arity, height=height, leaf_factor=factor, **more)


def leaf_count_column(n, factor):
    """leaf_count() as an expression of two columns."""
    capacity = lambda leaves: F.when(leaves == 1, 1).otherwise(F.greatest(F.lit(1), F.floor(leaves * factor)))
    return F.array_min(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long")), lambda x: x * capacity(x) >= n))
