"""The experiment: replay a log, and at checkpoints compare solutions on summaries with the full one."""

from __future__ import annotations

import logging
import time
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftsum.operators import baselines, coreset, kmeans, metrics, small
from driftsum.session import materialize, scratch_path
from driftsum.sources.oplog import REPORT
from driftsum.streaming.maintain import LiveSet, Settings, Summary

#: Positions of the report: the last 625 that are divisible by the step, as in the reference.
CHECKPOINTS = 625
logger = logging.getLogger("driftsum")


def _timed(f):
    start = time.monotonic()
    out = f()
    return out, (time.monotonic() - start) * 1e6


def positions(last: int, every: int, first: int = 0) -> list[int]:
    """The ends of the batches: ``first`` operations build the tree, then a batch ends after each position divisible by ``every``."""
    return sorted({at for at in range(0, last + 1, every) if at >= first - 1} | ({first - 1} if 0 < first <= last + 1 else set()))


def experiment(ops: DataFrame, settings: Settings, every: int, checkpoints: int = CHECKPOINTS, rounds: int = kmeans.ROUNDS, first: int = 0, exact: bool = True) -> DataFrame:
    """One row for each of the last ``checkpoints`` positions divisible by ``every``, with the columns of REPORT.

    Two summaries follow the live set from the first position on, in batches of ``every`` operations: the plain one
    (no noted deletes, no appends to inner nodes) and the one of ``settings``, whose cutoffs save work. The rows of a
    position are made from the summaries as they are then. Times are microseconds: those of following a batch are divided by its
    operations, all others are of one run. Solutions are run until the centres stand still (``rounds`` at most). The columns of the
    exact solvers stay 0 where the live set is too large for enumeration, or without ``exact``.
    """
    spark = ops.sparkSession
    ops = materialize(ops.select("seq", "point_id", "op", "weight", "coords"), "report-ops")
    last = ops.agg(F.max("seq")).first()[0]
    if last is None:
        return _frame(spark, [])
    state = scratch_path(spark, "report")
    live_set = LiveSet(spark, f"{state}/live")
    plain = replace(settings, insertion_factor=0.0, remove_factor=None, remove_fixed=0.0)
    summaries = {"d": Summary(spark, f"{state}/plain", plain), "o": Summary(spark, f"{state}/optimized", settings)}
    size = max(settings.k + 1, coreset.summary_size(settings.eps, settings.lam, settings.k, settings.dims, settings.size))
    rows, before = [], -1
    begin = max(0, last // every - checkpoints + 1) * every
    for batch, at in enumerate(positions(last, every, first)):
        change = live_set.apply(ops.where((F.col("seq") > before) & (F.col("seq") <= at)), batch)
        n_ops, before = at - before, at
        values: dict[str, float] = {"op": at}
        for name, summary in summaries.items():
            _, took = _timed(lambda summary=summary, change=change: summary.follow(change))
            values[f"{name}c_t"] = took / n_ops
        logger.info("position %s of %s", at, last)
        if at >= begin and at % every == 0:
            rows.append(_row(values, live_set.read().select("point_id", "weight", "coords"), summaries, settings, size, rounds, exact))
    return _frame(spark, rows)


def _row(values: dict[str, float], live: DataFrame, summaries: dict[str, Summary], settings: Settings, size: int, rounds: int, exact: bool) -> dict[str, float]:
    live = materialize(live, "report-live")
    n, k, seed = live.count(), settings.k, settings.seed
    solve = small.kmeans if n <= small.MOST_ROWS else kmeans.kmeans
    on_live = _Costs(live, n)
    full, values["t_t"] = _timed(lambda: solve(live, k, seed, rounds, kmeans.TOLERANCE))
    values["t_c"] = ton_t = on_live.average(full)
    numbered = F.monotonically_increasing_id().alias("point_id")
    makers = {
        "d": lambda: summaries["d"].rows().select(numbered, "weight", "coords"),
        "o": lambda: summaries["o"].rows().select(numbered, "weight", "coords"),
        "s": lambda: baselines.numbered_summary(coreset.summarize(live, k, size, seed, settings.dims, weighted=False)),
        "r": lambda: coreset.uniform_summary(live, size, seed).select(F.col("draw_no").alias("point_id"), "weight", "coords"),
    }
    for name, make in makers.items():
        summary, made = _timed(lambda make=make: materialize(make(), "report-summary", size))
        centres, solved = _timed(lambda summary=summary: small.kmeans(summary, k, seed, rounds, kmeans.TOLERANCE))
        on_summary = _Costs(summary, size)
        xon_t, xon_x, ton_x = on_live.average(centres), on_summary.average(centres), on_summary.average(full)
        ratios = (metrics.distortion(ton_t, ton_x, xon_x, xon_t), metrics.quality(ton_t, xon_t))
        if name == "r":
            values |= {"r_t": made, "r_c": xon_t, "rc_q": ratios[0], "rk_q": ratios[1]}
        else:
            values |= {f"{name}k_t": solved, f"{name}_c": xon_t, f"{name}c_q": ratios[0], f"{name}k_q": ratios[1]} | ({"sc_t": made} if name == "s" else {})
    values |= {f"{name}_{x}": 0.0 for name in ("ilp", "miqp") for x in "tc"}
    if exact and 0 < n <= baselines.MOST_POINTS and k <= 3:
        best, took = _timed(lambda: baselines.exact_kmeans(live, k).first())
        values |= {"miqp_t": took, "miqp_c": best["cost"] / on_live.weight}
        best, took = _timed(lambda: baselines.exact_medoids(live, k).first())
        values |= {"ilp_t": took, "ilp_c": best["cost"] / on_live.weight}
    return values


class _Costs:
    """Average costs on a table; a table of few rows is held in memory."""

    def __init__(self, points: DataFrame, n: int):
        self.points, self.rows = points, None
        if n <= small.MOST_ROWS:
            t = points.select("weight", "coords").toArrow()
            weights = t.column("weight").to_numpy()
            self.rows = weights, t.column("coords").combine_chunks().flatten().to_numpy().reshape(len(weights), -1)
            self.weight = float(weights.sum())
        else:
            self.weight = float(points.agg(F.sum("weight")).first()[0])

    def average(self, centres: list[tuple[int, list[float]]]) -> float:
        if not centres or not self.weight:
            return float("nan")
        if self.rows is None:
            return kmeans.sq_cost(self.points, centres)[0] / self.weight
        import numpy as np

        weights, coords = self.rows
        return float((weights * small.squared(coords, np.array([c for _, c in centres])).min(axis=1)).sum() / self.weight)


def _frame(spark, rows: list[dict[str, float]]) -> DataFrame:
    kind = lambda c: "long" if c == "op" else "double"
    return spark.createDataFrame([tuple(int(r[c]) if c == "op" else float(r[c]) for c in REPORT) for r in rows], ", ".join(f"{c} {kind(c)}" for c in REPORT))
