"""Keeping the live set and its summary up to date under a stream of operations.

All state is in a folder that the nodes share, one version for each micro-batch, and a version counts once its
meta file is there. A batch starts from the newest version below its own number, so a replayed batch gives what it
gave before, and a new driver goes on where the last one stopped. Versions are deltas: the live set writes what a batch
changed, the tree the nodes that it changed and a directory of all nodes; both are written anew in full
when their deltas outgrow them. The files of the newest two versions are kept.

The tree follows the reference scheme of phases: its sizes are set for ``np`` points, four times those alive, and set anew when
inserts less deletes pass an eighth of np. Deletes that miss the summary are only noted, and taken out of the tree
together: when one hits the summary, when more than the cutoff are noted, or when a phase ends. With each
operation one more leaf, in turn, is recomputed with its ancestors, until all were since the phase began.
"""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.operators import tree
from driftsum.operators.coreset import summary_size
from driftsum.operators.replay import live_set
from driftsum.session import drop_path, list_files, materialize, read_text, scratch_path, write_text

OPS = "seq long, point_id long, op int, weight double, coords array<double>"
POINTS = "point_id long, weight double, coords array<double>, seq long"
NODES = tree.ROWS + ", ver int"
DIRECTORY = "level int, node_id long, ver int, n long, w_milli long"
ROWS_KEPT = 100_000  # rows of deltas that are never worth a rewrite
logger = logging.getLogger("driftsum")


class Versions:
    """The meta files of a folder: batch -> what its version consists of."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        return sorted(int(name[6:-5]) for name in list_files(self.spark, f"{self.path}/meta") if name.startswith("batch-") and name.endswith(".json"))

    def newest(self, below: int | None = None) -> dict | None:
        found = [n for n in self.numbers() if below is None or n < below]
        return json.loads(read_text(self.spark, f"{self.path}/meta/batch-{found[-1]}.json")) if found else None

    def commit(self, meta: dict, folders: list[str]) -> None:
        """Make a version count; versions after it were made from another one and go, and so do files that the newest two do not use.

        ``folders`` are those below the path that versions use, each with folders named batch-N.
        """
        batch = meta["batch"]
        write_text(self.spark, f"{self.path}/meta/batch-{batch}.json", json.dumps(meta))
        numbers = self.numbers()
        before = [n for n in numbers if n < batch]
        kept = [meta, *([self.newest(batch)] if before else [])]
        for n in numbers:
            if n > batch or n in before[:-1]:
                drop_path(self.spark, f"{self.path}/meta/batch-{n}.json")
        used = {f"{folder}/batch-{n}" for m in kept for folder in folders for n in m["files"].get(folder, [])}
        for folder in folders:
            for name in list_files(self.spark, f"{self.path}/{folder}"):
                if name.startswith("batch-") and f"{folder}/{name}" not in used:
                    drop_path(self.spark, f"{self.path}/{folder}/{name}")


@dataclass
class Change:
    """What a batch did to the live set: points that it added (POINTS), and those it took away."""

    batch: int
    inserted: DataFrame
    deleted: DataFrame


class LiveSet:
    """The live points after each batch, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)
        self.path = self.versions.path

    @property
    def version(self) -> int | None:
        meta = self.versions.newest()
        return meta and meta["batch"]

    def read(self, below: int | None = None) -> DataFrame:
        """The points of the newest version (of those before batch ``below``)."""
        return self._read(self.versions.newest(below))

    def _read(self, meta: dict | None) -> DataFrame:
        if meta is None:
            return self.spark.createDataFrame([], POINTS)
        base = [self.spark.read.schema(POINTS).parquet(f"{self.path}/base/batch-{n}") for n in meta["files"]["base"]]
        deltas = [f"{self.path}/delta/batch-{n}" for n in meta["files"]["delta"]]
        if not deltas:
            return base[0]
        rows = self.spark.read.schema(OPS).parquet(*deltas)
        for b in base:
            rows = rows.unionAll(b.select("seq", "point_id", F.lit(1).alias("op"), "weight", "coords"))
        return live_set(rows)

    def apply(self, batch: DataFrame, batch_id: int) -> Change:
        """The next version: the old live points, as inserts at their own positions, and the batch are one log.

        Rows that come late (seq not above what earlier versions had) are left out.
        """
        meta = self.versions.newest(batch_id)
        seen = meta["last_seq"] if meta else -1
        log_ = batch.select(F.col("seq").cast("long").alias("seq"), F.col("point_id").cast("long").alias("point_id"), F.col("op").cast("int").alias("op"), F.col("weight").cast("double").alias("weight"), "coords")
        log_ = materialize(log_.where(F.col("seq") > seen), "live-log")
        before = self._read(meta).join(log_.select("point_id").distinct(), "point_id", "left_semi").select("seq", "point_id", F.lit(1).alias("op"), "weight", "coords")
        before = materialize(before, "live-before")
        after = live_set(before.unionAll(log_))
        same = ["point_id", "seq"]
        gone = before.join(after, same, "left_anti").select("seq", "point_id", F.lit(0).alias("op"), "weight", "coords")
        new = after.join(before, same, "left_anti").select("seq", "point_id", F.lit(1).alias("op"), "weight", "coords")
        path = f"{self.path}/delta/batch-{batch_id}"
        gone.unionAll(new).write.mode("overwrite").parquet(path)
        delta = self.spark.read.schema(OPS).parquet(path)
        row = delta.agg(F.count(F.lit(1)), F.coalesce(F.sum(2 * F.col("op") - 1), F.lit(0))).first()
        top = log_.agg(F.max("seq")).first()[0]
        files = meta["files"] if meta else {"base": [], "delta": []}
        new_meta = {"batch": batch_id, "last_seq": max(seen, -1 if top is None else top), "rows": (meta["rows"] if meta else 0) + row[1], "delta_rows": (meta["delta_rows"] if meta else 0) + row[0]}
        new_meta["files"] = {"base": files["base"], "delta": [*files["delta"], batch_id]}
        if new_meta["delta_rows"] > max(ROWS_KEPT, new_meta["rows"]) or len(new_meta["files"]["delta"]) > 50:
            self._read(new_meta).select("point_id", "weight", "coords", "seq").write.mode("overwrite").parquet(f"{self.path}/base/batch-{batch_id}")
            new_meta |= {"delta_rows": 0, "files": {"base": [batch_id], "delta": []}}
        self.versions.commit(new_meta, ["base"])
        self._clean()
        changed = lambda op: delta.where(F.col("op") == op).select("point_id", "weight", "coords", "seq")
        return Change(batch_id, changed(1), changed(0))

    def _clean(self) -> None:
        """Deltas that no kept version reads, but for those of the kept versions themselves: a summary may still follow them."""
        metas = [json.loads(read_text(self.spark, f"{self.path}/meta/batch-{n}.json")) for n in self.versions.numbers()]
        used = {n for m in metas for n in [*m["files"]["delta"], m["batch"]]}
        for name in list_files(self.spark, f"{self.path}/delta"):
            if name.startswith("batch-") and int(name[6:]) not in used:
                drop_path(self.spark, f"{self.path}/delta/{name}")


@dataclass(frozen=True)
class Settings:
    """k, dims: centres and coordinates; size: rows of the summary (0: from eps and lam).

    The factors multiply: k inside the tree, the size of its nodes, their cutoff, and the size up to which inserts are appended
    to nodes. ``remove_factor`` (of the live points) or ``remove_fixed`` is the number of noted deletes from which they are taken out.
    ``height`` and ``arity`` make a fixed-height tree, whose leaves hold ``leaf_factor`` times their number.
    """

    k: int
    dims: int
    size: int = 0
    eps: float = 0.5
    lam: float = 0.1
    cluster_factor: float = 1.0
    size_factor: float = 1.0
    cutoff_factor: float = 1.0
    insertion_factor: float = 0.0
    remove_factor: float | None = None
    remove_fixed: float = 0.0
    refresh: float = 1.0  # leaves recomputed for each operation
    seed: int = 7
    height: int | None = None
    arity: int = 2
    leaf_factor: float = 1.0

    def node_size(self, np: int) -> int:
        """Rows of a reduced node when sizes are set for ``np`` points."""
        np = max(2, np)
        own = summary_size(self.eps / (6 * ceil(log(np))), self.lam / (2 * np), self.k, self.dims, self.size)
        if own < 0:
            raise ValueError("eps must be above 0 and lam at most 0.5")
        return max(2, int(own * self.size_factor))

    def shape(self, np: int, n: int = 1) -> tree.Shape:
        """Sizes for ``np`` points; ``n``: points of a new fixed-height tree."""
        s = self.node_size(np)
        k = max(1, int(self.k * self.cluster_factor))
        more = {"k": k, "size": max(s, k + 1), "cutoff": int(s * self.cutoff_factor), "seed": self.seed, "insertion": int(s * self.insertion_factor)}
        if self.height:
            return tree.flat_shape(n, self.height, self.arity, self.leaf_factor, **more)
        return tree.Shape(leaf=max(1, s // 2), **more)


class Summary:
    """A tree of summaries that follows a live set, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings):
        self.spark, self.settings, self.versions = spark, settings, Versions(spark, path)
        self.path = self.versions.path

    def _directory(self, meta: dict) -> DataFrame:
        return self.spark.read.schema(DIRECTORY).parquet(*[f"{self.path}/directory/batch-{n}" for n in meta["files"]["directory"]])

    def _nodes(self, meta: dict) -> DataFrame:
        """All rows of the tree: those that the directory names."""
        rows = self.spark.read.schema(NODES).parquet(*[f"{self.path}/nodes/batch-{n}" for n in meta["files"]["nodes"]])
        return rows.join(self._directory(meta).select("level", "node_id", "ver"), ["level", "node_id", "ver"], "left_semi").select(*tree.NAMES)

    def tree(self, meta: dict | None = None) -> tree.Tree | None:
        meta = meta or self.versions.newest()
        return meta and tree.Tree(self._nodes(meta), self._shape(meta), meta["leaves"], meta["open"], meta["live"] + meta["noted"])

    def _shape(self, meta: dict) -> tree.Shape:
        return self.settings.shape(meta["np"])

    def rows(self) -> DataFrame:
        """(point_id, is_center, weight, coords) of the newest version."""
        meta = self.versions.newest()
        if meta is None:
            return self.spark.createDataFrame([], "point_id long, is_center boolean, weight double, coords array<double>")
        return self.spark.read.parquet(f"{self.path}/summary/batch-{meta['batch']}")

    def dump(self) -> DataFrame:
        """(level, node_id, n, w_milli, leaf, refreshed): the nodes; ``refreshed`` marks the leaf whose turn is next."""
        meta = self.versions.newest()
        if meta is None:
            return self.spark.createDataFrame([], "level int, node_id long, n long, w_milli long, leaf boolean, refreshed boolean")
        return self._directory(meta).select("level", "node_id", "n", "w_milli", (F.col("level") == 0).alias("leaf"), ((F.col("level") == 0) & (F.col("node_id") == meta["turn"])).alias("refreshed"))

    def follow(self, change: Change) -> None:
        """The next version of the tree, from what a batch did to the live set."""
        meta, batch = self.versions.newest(change.batch), change.batch
        n_in, n_out = change.inserted.count(), change.deleted.count()
        points = change.inserted.select("point_id", "weight", "coords")
        if meta is None or meta["live"] == 0:
            made = tree.build(points, self.settings.shape(4 * n_in, n_in))
            state = {"np": 4 * n_in, "updates": 0, "live": n_in, "noted": 0, "turn": 0, "rebuilt": (meta or {}).get("rebuilt", 0) + 1}
            self._commit(batch, state, made.rows, made.leaves, made.open, None)
            return
        live, updates = meta["live"] + n_in - n_out, meta["updates"] + n_in - n_out
        noted = change.deleted.select("point_id")
        if meta["noted"]:
            noted = self.spark.read.parquet(f"{self.path}/noted/batch-{meta['batch']}").unionAll(noted)
        over = abs(updates) * 8 >= max(1, meta["np"])
        cutoff = self.settings.remove_fixed if self.settings.remove_factor is None else self.settings.remove_factor * live
        n_noted = meta["noted"] + n_out
        hit = lambda ids: not noted.join(ids.select("point_id"), "point_id", "left_semi").isEmpty()
        flush = n_noted > 0 and (over or n_noted >= cutoff or hit(self.spark.read.parquet(f"{self.path}/summary/batch-{meta['batch']}")) or (n_in > 0 and hit(change.inserted)))
        state = {"np": meta["np"], "updates": updates, "live": live, "noted": 0 if flush else n_noted, "turn": meta["turn"], "rebuilt": meta["rebuilt"]}
        before = self.tree(meta)
        shape = before.shape
        if over:
            state |= {"np": 4 * live if updates > 0 else max(1, meta["np"] - meta["np"] // 2), "updates": 0, "turn": 0}
            shape = self.settings.shape(state["np"])
        turns = range(state["turn"], min(meta["leaves"], state["turn"] + ceil((n_in + n_out) * self.settings.refresh)))
        refresh = self.spark.range(turns.start, turns.stop).withColumnRenamed("id", "node_id") if len(turns) else None
        state["turn"] = turns.stop if len(turns) else state["turn"]
        if (shape.size, shape.cutoff, shape.insertion) != (before.shape.size, before.shape.cutoff, before.shape.insertion):  # every node has another size: all are computed
            level0, leaves, open_ = tree.update(before, points, noted if flush else None, shape)
            made = tree.over(materialize(tree.applied(before.level(0), level0), "tree"), shape)
            state["rebuilt"] += 1
            self._commit(batch, state, made.rows, leaves, open_, None if flush else noted)
            return
        level0, leaves, open_ = tree.update(before, points, noted if flush else None, shape, refresh)
        delta = materialize(tree.changes(before.rows, level0, leaves, shape, max(before.points, live)), "tree")
        self._commit(batch, state, delta, leaves, open_, None if flush else noted, meta)

    def _commit(self, batch: int, state: dict, rows: DataFrame, leaves: int, open_: int | None, noted: DataFrame | None, meta: dict | None = None) -> None:
        """Write a version: all rows of a new tree, or the changes to that of ``meta``."""
        path = f"{self.path}/nodes/batch-{batch}"
        new = rows.where("point_id is not null")
        new.select(*tree.NAMES, F.lit(batch).alias("ver")).write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(NODES).parquet(path)
        shape = self.settings.shape(state["np"])
        height = tree.height_of(leaves, shape)
        directory = written.groupBy("level", "node_id", "ver").agg(F.count(F.lit(1)).alias("n"), F.sum("w_milli").alias("w_milli"))
        files = [batch]
        if meta is not None:
            marks = rows.where("point_id is null").select("level", "node_id")
            directory = self._directory(meta).join(marks, ["level", "node_id"], "left_anti").select(directory.columns).unionAll(directory)
            files = [*meta["files"]["nodes"], batch]
        directory.where(F.col("level") <= height).write.mode("overwrite").parquet(f"{self.path}/directory/batch-{batch}")
        out = state | {"batch": batch, "leaves": leaves, "open": open_, "files": {"nodes": files, "directory": [batch]}}
        row = self._directory(out).agg(F.sum("n"), F.collect_set("ver")).first() if len(files) <= 1000 else None
        out["files"]["nodes"] = [n for n in files if row is None or n in row[1] or n == batch]
        out["stored"] = (meta["stored"] if meta else 0) + written.count()
        if meta is not None and (out["stored"] > max(ROWS_KEPT, 3 * (row[0] or 0)) or len(out["files"]["nodes"]) > 40):
            # all of the tree under one version; the changes just written are no longer needed
            whole = materialize(self._nodes(out), "tree")
            whole.select(*tree.NAMES, F.lit(batch).alias("ver")).write.mode("overwrite").parquet(path)
            again = self.spark.read.schema(NODES).parquet(path).groupBy("level", "node_id", "ver").agg(F.count(F.lit(1)).alias("n"), F.sum("w_milli").alias("w_milli"))
            again.write.mode("overwrite").parquet(f"{self.path}/directory/batch-{batch}")
            out["files"]["nodes"], out["stored"] = [batch], row[0]
        if noted is not None and state["noted"]:
            noted.write.mode("overwrite").parquet(f"{self.path}/noted/batch-{batch}")
            out["files"]["noted"] = [batch]
        summary = tree.outer(self._nodes(out).where(F.col("level") == height), shape, height)
        if "noted" in out["files"]:  # noted points are no longer alive
            summary = summary.join(self.spark.read.parquet(f"{self.path}/noted/batch-{batch}"), "point_id", "left_anti").select(summary.columns)
        summary.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/summary/batch-{batch}")
        out["files"]["summary"] = [batch]
        self.versions.commit(out, ["nodes", "directory", "noted", "summary"])
        logger.info("batch %s: %s live points, %s leaves, nodes of %s rows, %s deletes noted", batch, state["live"], leaves, shape.size, state["noted"])


def write_log(ops: DataFrame, path: str, files: int) -> None:
    """A log as ``files`` Parquet files in the order of seq, for a stream to read one after the other."""
    bounds = ops.agg(F.min("seq"), F.max("seq")).first()
    if bounds[0] is None:
        ops.write.mode("append").parquet(path)
        return
    step = (bounds[1] - bounds[0]) // files + 1
    for i in range(files):
        low = bounds[0] + i * step
        ops.where((F.col("seq") >= low) & (F.col("seq") < low + step)).coalesce(1).write.mode("append").parquet(path)


def replay(spark: SparkSession, log_path: str, settings: Settings | None = None, state: str | None = None) -> tuple[LiveSet, Summary | None]:
    """Read all files of a log as a stream, one file a batch, and keep the live set (and the summary, if settings are given).

    ``state``, a folder, holds what a later call with more files goes on from.
    """
    state = state or scratch_path(spark, "state")
    live = LiveSet(spark, f"{state}/live")
    summary = Summary(spark, f"{state}/summary", settings) if settings else None

    def step(batch: DataFrame, batch_id: int) -> None:
        change = live.apply(batch, batch_id)
        if summary:
            summary.follow(change)

    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(log_path)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    return live, summary
