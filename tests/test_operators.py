"""Small cases worked out by hand, and invariants."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftsum.operators import baselines, clustering, coreset, generators, grid_seeding, kmeans, metrics, replay, sampling, small, tree
from driftsum.sources import oplog
from driftsum.sources.points import pts_orders
from driftsum.streaming import maintain

SF = "/root/testdata/sf0.001"
POINTS = "point_id long, weight double, coords array<double>"
OPS = "seq long, point_id long, op int, weight double, coords array<double>"
FIVE = [(0, 1.0, [0.0, 0.0]), (1, 2.0, [0.0, 1.0]), (2, 1.0, [4.0, 0.0]), (3, 1.0, [4.0, 1.0]), (4, 1.0, [2.0, 0.5])]
CENTRES = [(0, [0.0, 0.0]), (1, [4.0, 0.0])]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, POINTS).coalesce(1)


def test_clean_log(spark, tmp_path):
    text = "# index flag weight x1 x2\n0 1 1 0 0\n1 1 2 0 1\n2,1,1,4,0\n3;1;1;4;1\n1\t0\t2\t0\t1\n4 1 0.5 2 2\n1 1 3 9 9\n3 0 1 4 1\n"
    (tmp_path / "log.txt").write_text(text)
    ops = oplog.read_ops(spark, f"file://{tmp_path}/log.txt", 2)
    rows = {r["point_id"]: (r["weight"], r["coords"]) for r in replay.live_set(ops).collect()}
    assert rows == {0: (1.0, [0.0, 0.0]), 1: (3.0, [9.0, 9.0]), 2: (1.0, [4.0, 0.0]), 4: (0.5, [2.0, 2.0])}
    assert {r["point_id"] for r in replay.live_set(ops, 4).collect()} == {0, 2, 3}


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    (tmp_path / "log.txt").write_text("".join(f"# c\n\n{i} 1 1 {i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = oplog.read_ops(spark, f"file://{tmp_path}/log.txt", 1).collect()
        assert oplog.read_ops(spark, f"file://{tmp_path}/log.txt", 1, 10).count() == 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["seq"], r["point_id"]) for r in rows) == [(i, i) for i in range(5000)]


def test_folders_are_read_by_path_and_place(spark, tmp_path):
    """Files of rising and falling sizes, cut into splits that the scan orders by size."""
    sizes, at = {"a.txt": 3, "b.txt": 900, "c.txt": 1, "d.txt": 300}, 0
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"# c\n{at + i} 1 1 {i}\n" for i in range(n)))
        at += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = oplog.read_ops(spark, f"file://{tmp_path}", 1).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["seq"], r["point_id"]) for r in rows) == [(i, i) for i in range(at)]


def test_command_line(spark, tmp_path):
    from driftsum.__main__ import first_rows, main, parse

    (tmp_path / "log.txt").write_text("".join(f"{i},1,1,{i % 17},{i % 5}\n" for i in range(300)))
    args = ["-f", f"file://{tmp_path}/log.txt", "-o", f"file://{tmp_path}/out", "-k", "2", "-d", "2", "-c", "20", "--skip", "150", "--checkpoints", "1", "--rounds", "2", "-i", "100", "-v", "10", "-x", "2"]
    o = parse(args)
    assert o.rows() == 20 and o.first == 100 and o.settings.remove_factor == 0.1 and o.settings.insertion_factor == 2
    main(args)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).splitlines()
    assert len(text) == 2 and text[1].startswith("150 ") and "nan" not in text[1]
    chosen = parse(["-f", "x", "-o", "y", "-k", "3", "-d", "2", "-e", "0.9", "-l", "0.5"])
    assert chosen.settings.node_size(4 * chosen.first) < chosen.first < 4 * chosen.settings.node_size(4 * chosen.first) or chosen.first == 50_000
    assert first_rows(chosen.settings) == chosen.first and first_rows(maintain.Settings(k=2, dims=2, size=40)) == 41
    for wrong in (["-k", "2"], ["-f", "x", "-o", "y", "-k", "2", "-d", "2"], [*args, "--vfixed", "3"], ["-f", "x", "-o", "y", "-k", "2", "-d", "2", "-e", "0", "-l", "0.1"]):
        with pytest.raises(SystemExit):
            parse(wrong)


def test_bad_lines_give_no_row(spark):
    lines = [(0, ""), (1, "1 1 1"), (2, "1 1 x 2 3"), (3, None), (4, " 5 1 1 2 3 99 "), (5, "  # 1 1 1 1 1")]
    rows = oplog.parse_ops(spark.createDataFrame(lines, "seq long, line string"), 2).collect()
    assert [(r["seq"], r["point_id"], r["coords"]) for r in rows] == [(4, 5, [2.0, 3.0])]


def test_dirty_log(spark):
    ops = spark.createDataFrame([(0, 7, 1, 1.0, [1.0, 1.0]), (1, 7, 1, 5.0, [2.0, 2.0]), (2, 8, 0, 1.0, [0.0, 0.0]), (3, 7, 0, 1.0, [0.0, 0.0]), (4, 7, 1, 2.0, [3.0, 3.0])], OPS)
    early, late = replay.live_set(ops, 2).collect(), replay.live_set(ops).collect()
    assert [(r["point_id"], r["weight"], r["coords"]) for r in early + late] == [(7, 1.0, [1.0, 1.0]), (7, 2.0, [3.0, 3.0])]
    lives = sorted((r["seq_in"], r["seq_out"]) for r in replay.lives(ops).collect())
    assert lives == [(0, 3), (4, None)]
    at = sorted((r["checkpoint"], r["weight"]) for r in replay.live_at(ops, 2, 4).collect())
    assert at == [(0, 1.0), (2, 1.0), (4, 2.0)]


def test_assignment(five):
    rows = clustering.assign(five, CENTRES)
    assert {r["point_id"]: r["cluster_id"] for r in rows.collect()} == {0: 0, 1: 0, 4: 0, 2: 1, 3: 1}
    assert metrics.sq_cost(five, CENTRES).first()["cost"] == pytest.approx(7.25)
    assert clustering.total_cost(rows).first()[0] == pytest.approx(4.061553, abs=1e-6)
    assert clustering.total_weighted_cost(rows).first()[0] == pytest.approx(5.061553, abs=1e-6)
    means = {r["cluster_id"]: (r["c0"], r["c1"]) for r in clustering.cluster_means(rows, 2).collect()}
    assert means == {0: (0.5, 0.625), 1: (4.0, 0.5)}
    assert {r["cluster_id"]: r["w_milli"] for r in clustering.cluster_weights(rows).collect()} == {0: 4000, 1: 2000}


def test_both_forms_of_assignment_agree(spark):
    points = pts_orders(spark, SF)
    few = clustering.first_centres(points, 7)
    many = [(i, c) for i in range(20) for _, c in [few[i % 7]]]
    a = {r["point_id"]: r["cluster_id"] for r in clustering.assign(points, few).collect()}
    from driftsum.functions import geometry

    geometry.UNROLL, old = 1, geometry.UNROLL
    try:
        b = {r["point_id"]: r["cluster_id"] for r in clustering.assign(points, many).collect()}
    finally:
        geometry.UNROLL = old
    assert a == b


def test_sensitivity_weights(five):
    rows = clustering.with_costs(clustering.assign(five, CENTRES))
    total = rows.agg(F.sum("wd")).first()[0]
    weights = {r["point_id"]: total / (3 * r["d"]) for r in rows.collect() if r["d"] > 0}
    drawn = five.sparkSession.createDataFrame([(0, weights[1]), (0, weights[4]), (0, weights[4])], "cluster_id int, weight double")
    out = {r["cluster_id"]: r["weight"] for r in coreset.centre_weights(rows, drawn).collect()}
    assert weights[1] == pytest.approx(1.687184, abs=1e-6) and weights[4] == pytest.approx(0.818404, abs=1e-6)
    assert out[0] == pytest.approx(0.676007, abs=1e-6) and out[1] == pytest.approx(2.0)


def test_summary_sizes():
    assert coreset.summary_size(0.5, 0.1, 3, 2) == 166
    assert coreset.summary_size(0.1, 0.1, 10, 4) == 21151
    assert coreset.summary_size(0, 0.1, 3, 2) == coreset.summary_size(0.5, 0.6, 3, 2) == -1
    assert coreset.summary_size(0.5, 0.1, 3, 2, fixed=40) == 40


def test_truncating_count(spark):
    row = spark.range(1).select(clustering.truncating_count(F.array(F.lit(0.5), F.lit(0.5), F.lit(1.7), F.lit(0.6)))).first()
    assert row[0] == 1


def test_grid_and_blocks(spark):
    rows = {r["point_id"]: r["coords"] for r in generators.grid(spark, 10).collect()}
    assert [rows[i] for i in (0, 3, 4, 9)] == [[0.0, 0.0], [0.0, 3.0], [1.0, 0.0], [2.0, 1.0]]
    kept = generators.block_skip(spark.range(9000), F.col("id")).orderBy("id").collect()
    assert [r["id"] for r in kept[:1] + kept[1000:1001]] == [0, 3000] and [r["point_id"] for r in kept] == [*range(3000)]


def test_hours(spark):
    row = spark.range(1).select(generators.hours(F.lit("2016-03-14 17:24:55").cast("timestamp"))).first()
    assert row[0] == pytest.approx(1793.415278, abs=1e-6)


def test_sliding_window_against_a_loop(spark):
    points = spark.createDataFrame([(i, 1.0, [float(i)]) for i in range(60)], POINTS)
    for window, p, seed in ((1, 0.5, 1), (5, 0.3, 2), (5, 0.9, 3), (100, 0.5, 4), (0, 0.1, 5)):
        from driftsum.functions import rng

        coins = [r["u"] for r in spark.range(200).select("id", rng.uniform(seed, "coin", F.col("id")).alias("u")).orderBy("id").collect()]
        log = [(i, 1) for i in range(min(window + 1, 60))]
        start, end = 0, len(log)
        for u in coins:
            if u < p:
                if end >= 60:
                    break
                log.append((end, 1))
                end += 1
            else:
                log.append((start, 0))
                start += 1
            if start >= end:
                break
        got = [(r["point_id"], r["op"]) for r in generators.sliding_window(points, window, p, seed).orderBy("seq").collect()]
        assert got == log, (window, p, seed)


@pytest.mark.parametrize("make", [lambda p: generators.constant_window(p, 20, 30, 0.7, 3, steps=100), lambda p: generators.snake_window(p, 50, 3)])
def test_random_victims_are_alive(spark, make):
    points = pts_orders(spark, SF)
    live = set()
    for r in make(points).orderBy("seq").collect():
        assert (r["point_id"] in live) == (r["op"] == 0)
        (live.add if r["op"] else live.discard)(r["point_id"])


def test_random_logs_are_joined_by_their_real_size(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # less than the log has
    try:
        plan = generators.snake_window(pts_orders(spark, SF), 50, 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_distortion_and_quality():
    assert metrics.distortion(2, 2.5, 1.8, 2.2) == pytest.approx(1.25)
    assert metrics.quality(2, 2.2) == pytest.approx(0.909091, abs=1e-6)
    assert metrics.distortion(0, 0, 1, 1) == 1.0


def test_leaf_capacity():
    assert [tree.leaf_count(n, 1) for n in (1, 2, 4, 5, 9)] == [1, 2, 2, 3, 3]
    assert [tree.leaf_count(n, 0.5) for n in (2, 3, 4, 8, 9)] == [2, 3, 4, 4, 5]


def test_degenerate_points(spark):
    same = spark.createDataFrame([(i, 1.0, [1.0, 2.0]) for i in range(6)], POINTS)
    rows = coreset.summarize(same, 3, 10, 1, 2).collect()
    assert [(r["is_center"], r["weight"], r["coords"]) for r in rows] == [(True, 6.0, [1.0, 2.0])]
    assert len(kmeans.seed_centres(same, 3, 1)) == 1
    assert len(kmeans.seed_centres(spark.createDataFrame(FIVE, POINTS), 5, 1)) == 5
    zero = spark.createDataFrame([(0, 0.0, [1.0]), (1, 1.0, [5.0])], POINTS)
    assert {r["point_id"] for r in sampling.weighted_sample(zero, F.col("weight"), 20, 1).collect()} == {1}
    assert kmeans.seed_centres(same.limit(0), 2, 1) == []


def test_summary_invariants(spark):
    points = pts_orders(spark, SF)
    total = points.agg(F.sum("weight")).first()[0]
    drawn = []
    for seed in range(12):
        rows = coreset.summarize(points, 3, 60, seed, 2).collect()
        draws = [r for r in rows if not r["is_center"]]
        assert len(draws) == 60 and len(rows) - 60 <= 3
        centres = kmeans.ordered_by_id(kmeans.seed_centres(points, 3, seed))
        by = {r["cluster_id"]: r["w"] for r in clustering.assign(points, centres).groupBy("cluster_id").agg(F.sum("weight").alias("w")).collect()}
        for c, w in by.items():
            inside = sum(r["weight"] for r in draws if r["cluster_id"] == c)
            everything = sum(r["weight"] for r in rows if r["cluster_id"] == c)
            assert everything == pytest.approx(max(w, inside))
        drawn.append(sum(r["weight"] for r in draws))
    assert abs(statistics.mean(drawn) / total - 1) < 0.25


def test_light_clusters_have_true_means(spark):
    points = spark.createDataFrame([(0, 0.25, [4.0, 8.0]), (1, 0.25, [6.0, 8.0]), (2, 0.0, [90.0, 90.0])], POINTS)
    assert kmeans.lloyd_step(points, [(0, [5.0, 5.0]), (1, [90.0, 91.0]), (2, [500.0, 0.0])]) == [(0, [5.0, 8.0]), (1, [90.0, 91.0]), (2, [500.0, 0.0])]


def test_rows_in_memory_are_solved_alike(spark):
    points = pts_orders(spark, SF).where("point_id % 5 = 0")
    for k, seed in ((1, 3), (3, 4)):
        far, near = kmeans.kmeans(points, k, seed), small.kmeans(points, k, seed, kmeans.ROUNDS, kmeans.TOLERANCE)
        assert [i for i, _ in far] == [i for i, _ in near]
        assert [x for _, c in far for x in c] == pytest.approx([x for _, c in near for x in c])
    assert small.kmeans(points.limit(0), 2, 1, 3, 0.0) == []


def test_more_rows_than_fit_in_memory_are_solved_too(spark, monkeypatch):
    points = pts_orders(spark, SF)
    near = small.kmeans(points, 3, 4, kmeans.ROUNDS, kmeans.TOLERANCE)
    monkeypatch.setattr(small, "MOST_ROWS", 1000)
    assert points.count() > small.MOST_ROWS
    far = small.kmeans(points, 3, 4, kmeans.ROUNDS, kmeans.TOLERANCE)
    assert [i for i, _ in far] == [i for i, _ in near]
    assert [x for _, c in far for x in c] == pytest.approx([x for _, c in near for x in c])


def test_seeds_with_a_written_distance(spark, monkeypatch):
    points = pts_orders(spark, SF).where("point_id % 7 = 0")
    plain = kmeans.seed_centres(points, 7, 2)
    monkeypatch.setattr(kmeans, "REFRESH", 2)
    assert kmeans.seed_centres(points, 7, 2) == plain and len(plain) == 7


def test_buckets_of_regular_ids(spark):
    """Ids that step by a power of two are spread like others."""
    rows = spark.range(0, 1000 * 65_536, 65_536).select(sampling.bucket(F.col("id")).alias("b")).distinct().count()
    assert rows > 950
    points = spark.range(0, 1000 * 65_536, 65_536).select(F.col("id").alias("point_id"), F.lit(1.0).alias("weight"))
    assert sampling.weighted_sample(points, F.col("weight"), 50, 1).count() == 50


def test_draws_order_only_drawn_buckets(spark):
    points = pts_orders(spark, SF)
    drawn = sampling.weighted_sample(points, F.col("weight"), 5, 3)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    window, scan = plan.index("Window"), plan.index("LeftSemi")
    assert window < scan  # in the printed tree, what is below comes later


def test_heights():
    shape = tree.Shape(fan_in=3)
    assert [tree.height_of(n, shape) for n in (0, 1, 2, 3, 4, 243, 244)] == [0, 0, 1, 1, 2, 5, 6]
    assert tree.height_of(279_936, tree.Shape(fan_in=6)) == 7 and tree.height_of(5, tree.flat_shape(10, 4, 6)) == 3


def of_tree(t):
    return sorted((r["level"], r["node_id"], r["point_id"], r["is_center"], r["w_milli"], tuple(r["coords"])) for r in t.rows.collect())


def sizes_of(t, level=0):
    return {r["node_id"]: r["count"] for r in t.level(level).groupBy("node_id").count().collect()}


def check_tree(t, ids):
    """What must hold for any tree: its points, dense leaves of the right sizes, and nodes that a full computation gives, too."""
    assert sorted(r["point_id"] for r in t.level(0).collect()) == sorted(ids)
    sizes = sizes_of(t)
    assert {*sizes} <= {*range(t.leaves)}
    if t.shape.height is None:
        assert len(sizes) == t.leaves and all(n >= t.shape.leaf for leaf, n in sizes.items() if leaf != t.open)
        assert t.open is None or sizes[t.open] < t.shape.leaf
    else:
        assert max(sizes.values(), default=0) <= tree.leaf_capacity(t.leaves, t.shape.leaf_factor)
    assert of_tree(t) == of_tree(tree.over(t.level(0), t.shape))


def test_tree_follows_changes(spark, monkeypatch):
    """Inserts and deletes in turn, in one band and in many."""
    points = pts_orders(spark, SF).where("point_id < 1200")
    ids = [r["point_id"] for r in points.select("point_id").collect()]
    shape = tree.Shape(leaf=20, size=12, cutoff=15)
    for rows in (1 << 16, 1):
        monkeypatch.setattr(tree, "BAND_ROWS", rows)
        monkeypatch.setattr(tree, "MEMORY_ROWS", -1 if rows == 1 else 100_000)
        t = tree.build(points.where("point_id % 3 = 0"), shape)
        live = {i for i in ids if i % 3 == 0}
        check_tree(t, live)
        steps = [("point_id % 3 = 1 and point_id < 500", "point_id < 0")] if rows == 1 else [("point_id % 3 = 1 and point_id < 200", "point_id < 0"), ("point_id < 0", "point_id % 3 = 0 and point_id < 700"), ("point_id % 3 = 2 and point_id > 900", "point_id % 5 = 1")]
        for new, gone in steps:
            level0, leaves, open_ = tree.update(t, points.where(new), points.where(gone).select("point_id"))
            t = tree._changed(t, level0, leaves, open_, shape)
            live = (live - {r["point_id"] for r in points.where(gone).collect()}) | {r["point_id"] for r in points.where(new).collect()}
            check_tree(t, live)
    assert tree.summary(t).count() <= shape.size
    empty = tree.delete(t, points.select("point_id"))
    assert empty.leaves == 0 and empty.rows.isEmpty()
    check_tree(tree.insert(empty, points.limit(30)), [r["point_id"] for r in points.limit(30).collect()])


def test_trees_in_memory_change_alike(spark, monkeypatch):
    """Deletes, inserts and refreshed leaves at once, and a new shape: the same tree in memory and by distributed steps."""
    points = pts_orders(spark, SF).withColumn("weight", F.col("weight") + 0.005)

    def run(most):
        monkeypatch.setattr(tree, "MEMORY_ROWS", most)
        shape = tree.Shape(leaf=40, size=12, cutoff=12, insertion=60)
        t = tree.build(points.where("point_id % 3 = 0"), shape)
        t = tree._changed(t, *tree.update(t, points.where("point_id % 3 = 1 and point_id < 300"), points.where("point_id % 3 = 0 and point_id < 700").select("point_id"), None, spark.range(2, 4).withColumnRenamed("id", "node_id")), shape)
        out = [(of_tree(t), t.leaves, t.open)]
        t = tree.rebalance(t, tree.Shape(leaf=15, size=12, cutoff=12))
        return [*out, (of_tree(t), t.leaves, t.open)]

    assert run(100_000) == run(-1)


def test_appends_reach_inner_nodes_without_reductions(spark):
    points = pts_orders(spark, SF)
    shape = tree.Shape(leaf=20, size=12, cutoff=12, insertion=200)
    before = tree.build(points.where("point_id < 390"), shape)
    after = tree.insert(before, points.where("point_id = 400"))
    for level in range(1, after.height + 1):
        old, new = ({(r["node_id"], r["point_id"], r["w_milli"]) for r in t.level(level).collect()} for t in (before, after))
        assert {p for _, p, _ in new - old} == {400} and not old - new
    full = tree.insert(tree.build(points.where("point_id < 390"), tree.Shape(leaf=20, size=12, cutoff=12)), points.where("point_id = 400"))
    assert full.level(full.height).count() <= 12


def test_fixed_height_grows_and_shrinks(spark):
    points = pts_orders(spark, SF).where("point_id < 200")
    ids = [r["point_id"] for r in points.collect()]
    t = tree.build(points, tree.flat_shape(len(ids), 4, 3, size=10, cutoff=10))
    check_tree(t, ids)
    less = tree.delete(t, points.where("point_id >= 20").select("point_id"))
    check_tree(less, [i for i in ids if i < 20])
    assert less.leaves <= 6 < t.leaves and max(sizes_of(less).values()) <= less.leaves
    check_tree(tree.insert(less, points.where("point_id >= 20 and point_id < 60")), [i for i in ids if i < 60])


def test_reductions_keep_each_clusters_weight():
    rng = np.random.default_rng(1)
    ids, milli, coords = np.arange(300), rng.integers(1, 5000, 300), rng.normal(size=(300, 2))
    out_ids, centre, w, x = small.reduce_rows(ids, milli, coords, 3, 40, 7, "1:0")
    again = small.reduce_rows(ids[::-1], milli[::-1], coords[::-1], 3, 40, 7, "1:0")
    assert all((a == b).all() for a, b in zip((out_ids, centre, w, x), again, strict=True))
    assert len(out_ids) == 40 and centre.sum() == 3 and w.dtype.kind == "i"
    assert w.sum() >= milli.sum() and all((coords[i] == c).all() for i, c, m in zip(out_ids, x, centre, strict=True) if not m)
    same = small.reduce_rows(ids, milli, np.ones((300, 2)), 3, 40, 7, "1:0")
    assert same[0].tolist() == [-1] and same[2].tolist() == [milli.sum()]


def versions_of(spark, path, batches):
    """A new object for each batch, as after a restart of the driver; returns the live set of each version."""
    out = []
    for i, batch in batches:
        maintain.LiveSet(spark, path).apply(batch, i)
        out.append(sorted((r["point_id"], r["seq"], r["weight"]) for r in maintain.LiveSet(spark, path).read().collect()))
    return out


def test_batches_are_replayed_and_resumed(spark, tmp_path):
    path = f"file://{tmp_path}/live"
    first = spark.createDataFrame([(0, 1, 1, 1.0, [0.0]), (1, 2, 1, 1.0, [0.0])], OPS)
    second = spark.createDataFrame([(2, 1, 0, 1.0, [0.0]), (3, 3, 1, 1.0, [0.0]), (1, 2, 0, 1.0, [0.0])], OPS)  # the last row comes late
    third = spark.createDataFrame([(4, 3, 0, 1.0, [0.0]), (5, 3, 1, 9.0, [5.0]), (6, 4, 1, 1.0, [0.0])], OPS)
    batches = [(0, first), (1, second), (1, second), (2, third), (2, third)]
    got = versions_of(spark, path, batches)
    assert got == [[(1, 0, 1.0), (2, 1, 1.0)], *[[(2, 1, 1.0), (3, 3, 1.0)]] * 2, *[[(2, 1, 1.0), (3, 5, 9.0), (4, 6, 1.0)]] * 2]
    live = maintain.LiveSet(spark, path)
    assert live.version == 2 and live.versions.numbers() == [1, 2]
    change = live.apply(third, 2)
    assert [r["point_id"] for r in change.deleted.collect()] == [3] and sorted(r["point_id"] for r in change.inserted.collect()) == [3, 4]


def test_compaction_keeps_the_live_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintain, "ROWS_KEPT", 3)
    ops = [(i, i % 7, int(i % 3 > 0), float(i), [0.0]) for i in range(40)]
    path = f"file://{tmp_path}/live"
    for i in range(4):
        maintain.LiveSet(spark, path).apply(spark.createDataFrame(ops[i * 10 : i * 10 + 10], OPS), i)
    key = lambda df: sorted((r["point_id"], r["seq"], r["weight"]) for r in df.collect())
    assert key(maintain.LiveSet(spark, path).read()) == key(replay.live_set(spark.createDataFrame(ops, OPS)))
    assert len(list((tmp_path / "live" / "base").glob("batch-*"))) <= 2


def follow(spark, path, settings, batches):
    for i, batch in batches:  # new objects each time
        maintain.Summary(spark, f"{path}/tree", settings).follow(maintain.LiveSet(spark, f"{path}/live").apply(spark.createDataFrame(batch, OPS), i))
    return maintain.Summary(spark, f"{path}/tree", settings)


def inserts(first, last, seq=None, weight=1.0):
    return [((first if seq is None else seq) + i, first + i, 1, weight, [float((first + i) % 13), float((first + i) % 7)]) for i in range(last - first)]


def test_summary_follows_the_live_set(spark, tmp_path):
    """Restarts, a replayed batch, a reinserted point, an open leaf, noted deletes."""
    path, settings = f"file://{tmp_path}", maintain.Settings(k=2, dims=2, size=20, remove_fixed=4)
    s = follow(spark, path, settings, [(0, inserts(0, 95)), (1, [(95, 95, 1, 1.0, [1.0, 1.0])]), (2, [(96, 96, 1, 1.0, [2.0, 2.0])]), (3, [(97, 97, 1, 1.0, [3.0, 3.0])])])
    t = s.tree()
    assert t.leaves == 10 and t.open == 9 and sizes_of(t)[9] == 8  # one leaf takes the three batches
    check_tree(t, range(98))
    kept = {r["point_id"] for r in s.rows().collect()}
    out = next(i for i in range(90) if i not in kept)
    s = follow(spark, path, settings, [(4, [(98, out, 0, 1.0, [0.0, 0.0])])])
    assert s.versions.newest()["noted"] == 1 and s.tree().level(0).count() == 98  # only noted
    for _ in range(2):  # the point that went comes back elsewhere, and the batch is replayed
        s = follow(spark, path, settings, [(5, [(99, out, 1, 5.0, [999.0, 0.0])])])
        rows = [r for r in s.tree().level(0).collect() if r["point_id"] == out]
        assert [(r["w_milli"], r["coords"]) for r in rows] == [(5000, [999.0, 0.0])] and s.versions.newest()["noted"] == 0
    check_tree(s.tree(), range(98))
    s = follow(spark, path, settings, [(6, [(100 + i, i, 0, 1.0, [0.0, 0.0]) for i in range(30, 82)])])
    check_tree(s.tree(), [i for i in range(98) if not 30 <= i < 82])
    assert s.versions.newest()["updates"] == 0 and s.versions.newest()["np"] == 4 * 95 - 4 * 95 // 2  # the phase ended
    dump = s.dump().collect()
    assert sum(r["n"] for r in dump if r["leaf"]) == 46 and {r["level"] for r in dump if r["refreshed"]} <= {0}
    assert sum(r["w_milli"] for r in dump if r["leaf"]) == 46_000 + 4_000 * (not 30 <= out < 82)
    assert {r["point_id"] for r in s.rows().collect()} <= {-1, *[i for i in range(98) if not 30 <= i < 82]}


def test_summary_sizes_follow_the_phase(spark, tmp_path, monkeypatch):
    """Without a fixed size, nodes grow with the number of points, and the tree is computed anew."""
    monkeypatch.setattr(maintain, "ROWS_KEPT", 10)
    settings = maintain.Settings(k=1, dims=2, eps=20.0, lam=0.5, refresh=0.5)
    s = follow(spark, f"file://{tmp_path}", settings, [(0, inserts(0, 60)), (1, inserts(60, 70)), (2, inserts(70, 200)), (3, inserts(200, 203))])
    meta = s.versions.newest()
    assert meta["np"] == 800 and meta["rebuilt"] == 2 and meta["live"] == 203 and s.tree().shape.size == settings.node_size(800) > settings.node_size(240)
    check_tree(s.tree(), range(203))


def test_summary_of_fixed_height(spark, tmp_path):
    settings = maintain.Settings(k=2, dims=2, size=10, height=3, arity=3)
    s = follow(spark, f"file://{tmp_path}", settings, [(0, inserts(0, 50)), (1, inserts(50, 80)), (2, [(100 + i, i, 0, 1.0, [0.0, 0.0]) for i in range(70)])])
    check_tree(s.tree(), range(70, 80))
    assert s.tree().leaves <= 4


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    from driftsum.sources.points import ops_events

    ops = ops_events(spark, SF)
    key = lambda df: sorted((r["point_id"], r["seq"], r["weight"]) for r in df.collect())
    settings = maintain.Settings(k=2, dims=2, size=6)
    maintain.write_log(ops.where("seq < 600"), f"file://{tmp_path}/log", 3)
    live, _ = maintain.replay(spark, f"file://{tmp_path}/log", settings, f"file://{tmp_path}/state")
    assert key(live.read()) == key(replay.live_set(ops, 599))
    maintain.write_log(ops.where("seq >= 600"), f"file://{tmp_path}/log", 2)
    live, summary = maintain.replay(spark, f"file://{tmp_path}/log", settings, f"file://{tmp_path}/state")
    assert key(live.read()) == key(replay.live_set(ops))
    check_tree(summary.tree(), [r["point_id"] for r in live.read().collect()])


def test_exact_solutions_are_lower_bounds(five):
    medoids = baselines.exact_medoids(five, 2).first()
    best = baselines.exact_kmeans(five, 2).first()
    for seed in range(5):
        cost, _ = kmeans.sq_cost(five, kmeans.kmeans(five, 2, seed))
        assert best["cost"] <= cost + 1e-3 and best["cost"] <= medoids["cost"] + 1e-3


def test_fast_seeds_against_a_loop(spark, monkeypatch):
    """Every round by plain Python over all points."""
    monkeypatch.setattr(grid_seeding, "PROPOSALS", 5)
    points = pts_orders(spark, SF).where("point_id % 6 = 0")
    rows = {r["point_id"]: (r["weight"], list(r["coords"])) for r in points.collect()}
    ids = np.array(sorted(rows))
    ids = ids[small.in_bucket_order(ids)].tolist()
    got = grid_seeding.fast_seeds(points, 9, 2, 5)
    grids = grid_seeding.grids_for(points, 2, 5)
    cells = {i: grids.cells_of(rows[i][1]) for i in ids}
    seeds, turn = [], 0
    while len(seeds) < 9:
        near = {i: min([grid_seeding.FAR, *(grids.difference_of(cells[i], cells[s]) for s in seeds)]) for i in ids}
        weights = np.array([rows[i][0] * (grids.distance_of(near[i]) ** 2 if seeds else 1.0) for i in ids])
        n = 5 if seeds else 1
        drawn = [ids[k] for k in small.draw(weights, small.uniforms(5, f"fast{turn}", range(n)))]
        new = []
        for j, i in enumerate(drawn):
            now = min([near[i], *(grids.difference_of(cells[i], cells[s]) for s in new)])
            if not seeds or now == near[i] or small.uniform(5, f"accept{turn}", j) < (grids.distance_of(now) / grids.distance_of(near[i])) ** 2:
                new.append(i)
        seeds, turn = seeds + new[: 9 - len(seeds)], turn + 1
    assert [key for _, _, key in got] == seeds and len(set(seeds)) == 9
    assert all(list(c) == rows[key][1] for _, c, key in got)


def test_fast_seeds_with_an_outlier_and_equal_points(spark):
    far = spark.createDataFrame([(i, 1.0, [float(i % 10), float(i // 10)]) for i in range(100)] + [(1000, 1.0, [1e6, 1e6])], POINTS)
    assert len({key for _, _, key in grid_seeding.fast_seeds(far, 12, 2, 1)}) == 12
    same = spark.createDataFrame([(i, 1.0, [1.0, 2.0]) for i in range(6)], POINTS)
    assert len(grid_seeding.fast_seeds(same, 3, 2, 1)) == 1 and grid_seeding.fast_seeds(same.limit(0), 3, 2, 1) == []


def test_report_file(spark, tmp_path):
    rows = spark.range(2).select(F.col("id").alias("op"), *[F.lit(1.5).alias(c) for c in oplog.REPORT[1:]])
    oplog.write_report(rows, f"file://{tmp_path}/report")
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*"))).splitlines()
    assert text[0].startswith("# op ") and len(text) == 3 and len(text[1].split()) == 26


def test_live_set_plan_has_no_sort_of_everything(spark):
    from driftsum.sources.points import ops_events

    plan = replay.live_set(ops_events(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
