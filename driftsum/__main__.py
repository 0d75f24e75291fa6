"""Command line: replay a log of inserts and deletes and report on summaries of what is alive.

    python -m driftsum -f log.txt -o report -k 10 -d 2 -c 200
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from driftsum.operators.coreset import summary_size
from driftsum.plans.report import CHECKPOINTS
from driftsum.streaming.maintain import Settings


@dataclass(frozen=True)
class Options:
    """file: a log; output: a folder; n: lines to read (all if none); first: operations that build the tree (0: chosen from the sizes)."""

    file: str
    output: str
    settings: Settings
    n: int | None = None
    first: int = 0
    skip: int = 20
    checkpoints: int = CHECKPOINTS
    rounds: int = 300
    exact: bool = True

    def rows(self) -> int:
        s = self.settings
        return summary_size(s.eps, s.lam, s.k, s.dims, s.size)


def first_rows(settings: Settings, most: int = 50_000) -> int:
    """The operations that build a tree: more than a node's rows, and less than four times as many."""
    if settings.size:
        return int((settings.size + 1) * settings.size_factor)
    return next((n for n in range(10, most + 1, 10) if settings.node_size(4 * n) < n < 4 * settings.node_size(4 * n)), most)


def parse(args: Sequence[str] | None = None) -> Options:
    p = argparse.ArgumentParser(prog="driftsum", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("-f", "--file", required=True, help="the log")
    p.add_argument("-o", "--output", required=True, help="the report's folder")
    p.add_argument("-k", type=int, required=True, help="centres")
    p.add_argument("-d", "--dims", type=int, required=True, help="coordinates of a point")
    p.add_argument("-n", type=int, help="operations to read; all without it")
    p.add_argument("-e", "--eps", type=float, help="error of the summary, with -l; or -c")
    p.add_argument("-l", "--lam", type=float, help="probability of a larger error")
    p.add_argument("-c", "--size", type=int, default=0, help="rows of the summary")
    p.add_argument("-i", "--first", type=int, default=0, help="operations that build the tree")
    p.add_argument("-y", "--cluster-factor", type=float, default=1.0, help="centres inside the tree, as a multiple of k")
    p.add_argument("-s", "--size-factor", type=float, default=1.0, help="rows of a node, as a multiple of the summary's")
    p.add_argument("-t", "--cutoff-factor", type=float, default=1.0, help="rows up to which a node is kept whole, as a multiple of its size")
    p.add_argument("-x", "--insertion-factor", type=float, default=1.0, help="rows up to which inserts are appended to a node, as a multiple of its size")
    p.add_argument("-v", "--remove-percent", type=float, help="noted deletes that are taken out together, in percent of the live points")
    p.add_argument("--vfixed", type=float, default=0.0, help="the same as a number")
    p.add_argument("-p", "--exact-factor", type=float, default=1.0, help="0 leaves the exact solvers out; they enumerate, so other factors change nothing")
    p.add_argument("-m", "--leaf-factor", type=float, default=1.0, help="points of a leaf of a fixed-height tree, as a multiple of the number of leaves")
    p.add_argument("--height", type=int, help="levels of a fixed-height tree; a binary one without it")
    p.add_argument("--arity", type=int, default=2, help="children of a node of a fixed-height tree")
    p.add_argument("--skip", type=int, default=20, help="operations from row to row of the report")
    p.add_argument("--checkpoints", type=int, default=CHECKPOINTS, help="rows of the report at most")
    p.add_argument("--rounds", type=int, default=300, help="rounds of a solution at most")
    p.add_argument("--seed", type=int, default=7)
    a = p.parse_args(args)
    if not a.size and (a.eps is None or a.lam is None):
        p.error("needs -c, or -e and -l")
    if a.remove_percent is not None and a.vfixed:
        p.error("-v and --vfixed exclude each other")
    settings = Settings(
        k=a.k, dims=a.dims, size=a.size, eps=a.eps or 0.0, lam=a.lam or 0.0, cluster_factor=a.cluster_factor, size_factor=a.size_factor, cutoff_factor=a.cutoff_factor, insertion_factor=a.insertion_factor,
        remove_factor=None if a.remove_percent is None else a.remove_percent / 100, remove_fixed=a.vfixed, seed=a.seed, height=a.height, arity=a.arity, leaf_factor=a.leaf_factor,
    )
    if summary_size(settings.eps, settings.lam, settings.k, settings.dims, settings.size) < 0:
        p.error("eps must be above 0 and lam at most 0.5")
    return Options(a.file, a.output, settings, a.n, a.first or first_rows(settings), a.skip, a.checkpoints, a.rounds, a.exact_factor > 0)


def main(args: Sequence[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from driftsum.plans.report import experiment
    from driftsum.sources.oplog import read_ops, write_report

    o = parse(args)
    logging.basicConfig(format="%(message)s", level=logging.INFO)
    spark = SparkSession.builder.appName("driftsum").getOrCreate()
    ops = read_ops(spark, o.file, o.settings.dims, o.n)
    write_report(experiment(ops, o.settings, o.skip, o.checkpoints, o.rounds, o.first, o.exact), o.output)


if __name__ == "__main__":
    main()
