"""The registered queries: each applies an operator to the driver's tables; SQL restates it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftsum.functions import geometry, rng
from driftsum.operators import baselines, clustering, coreset, generators, grid_seeding, kmeans, metrics, replay, sampling, small, tree
from driftsum.plans import sql as q
from driftsum.session import materialize, scratch_path, table
from driftsum.sources import oplog
from driftsum.sources.points import ops_events, pts_emb, pts_line, pts_nation, pts_orders, pts_region, spread
from driftsum.streaming import maintain

SEED, K, DRAWS = 7, 4, 200
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Q = lambda x: F.round(x, 4)


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def _five(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    points = pts_orders(spark, sf_dir)
    return points, clustering.first_centres(points, 5)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.assign(*_five(spark, sf_dir))


ORDERS = q.points("pts_orders")
ASSIGNED = q.with_(ORDERS, q.first_centres(), q.assigned())
COSTED = q.with_(ORDERS, q.first_centres(), q.assigned(), "costed AS (SELECT *, sqrt(d2) AS d, weight * sqrt(d2) AS wd FROM assigned)")
EVENTS = q.points("ops_events")
NATIONS = q.points("pts_nation")


# sources


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log lines with all four separators, and a comment before every tenth."""
    rows = ops_events(spark, sf_dir)
    separator = F.element_at(F.array(F.lit("\t"), F.lit(" "), F.lit(","), F.lit("; ")), (F.col("seq") % 4 + 1).cast("int"))
    parts = F.array(F.col("point_id").cast("string"), F.col("op").cast("string"), F.col("weight").cast("string"), F.col("coords")[0].cast("string"), F.col("coords")[1].cast("string"))
    line = F.concat(F.array_join(parts, "|"))
    line = F.regexp_replace(line, r"\|", separator)
    comment = rows.where("seq % 10 = 0").select("seq", F.concat(F.lit("# "), F.col("seq").cast("string")).alias("line"))
    return rows.select("seq", line.alias("line")).unionAll(comment)


@query(q.with_(EVENTS) + "SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, point_id, op::INTEGER AS op, weight, x0, x1 FROM ops_events")
def ops_scan(spark, sf_dir):
    """The log as the files of a folder, read back in order."""
    path = scratch_path(spark, "log-text")
    _log_lines(spark, sf_dir).orderBy("seq", "line").select("line").write.text(path)
    return spread(oplog.read_ops(spark, path, 2), 2, "seq", "point_id", "op", "weight")


@query("SELECT vec_id AS seq, (label + 1)::INTEGER AS label FROM embeddings")
def labels_scan(spark, sf_dir):
    rows = pts_emb(spark, sf_dir)
    lines = rows.select(F.col("point_id").alias("seq"), (F.col("label") + 1).cast("string").alias("line"))
    return oplog.parse_labels(lines).select("seq", "label")


# builders of data sets


@query(q.with_(q.points("pts_line")) + "SELECT min(point_id) AS point_id, count(*)::DOUBLE AS weight, x0, x1, x2 FROM pts_line GROUP BY x0, x1, x2")
def dedupe_weight(spark, sf_dir):
    return spread(generators.dedupe_weight(pts_line(spark, sf_dir)), 3, "point_id", "weight")


@query("SELECT o_orderkey AS point_id, md5('7:' || o_orderkey) AS place FROM orders ORDER BY place, point_id")
def shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("point_id"))
    return generators.shuffled(rows, SEED).withColumn("place", F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col("point_id").cast("string"))))


WINDOW, P = 500, 0.6


@query(
    q.with_(
        "pts AS (SELECT o_orderkey AS point_id FROM orders)",
        "src AS (SELECT point_id, row_number() OVER (ORDER BY point_id) - 1 AS place FROM pts)",
        "n AS (SELECT count(*) AS n, least(501, count(*)) AS first FROM pts)",
        f"coins AS (SELECT t, ins, sum(ins) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS up, sum(1 - ins) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS down FROM (SELECT t, CASE WHEN {q.u(SEED, 'coin', 't')} < 0.6 THEN 1 ELSE 0 END AS ins FROM (SELECT unnest(range(2 * n + 2)) AS t FROM n)))",
        "stop_ AS (SELECT min(t) AS t FROM coins, n WHERE up + first > n OR up + first - down <= 0)",
        "moves AS (SELECT first + c.t AS seq, CASE WHEN ins = 1 THEN first + up - 1 ELSE down - 1 END AS place, ins AS op FROM coins c, n, stop_ s WHERE s.t IS NULL OR c.t < s.t OR (c.t = s.t AND up + first - down <= 0))",
        "log AS (SELECT i AS seq, i AS place, 1 AS op FROM (SELECT unnest(range(first)) AS i FROM n) UNION ALL SELECT seq, place, op FROM moves)",
    )
    + "SELECT seq::BIGINT AS seq, point_id, op::INTEGER AS op FROM log JOIN src USING (place)"
)
def win_sliding(spark, sf_dir):
    return generators.sliding_window(pts_orders(spark, sf_dir), WINDOW, P, SEED).select("seq", "point_id", F.col("op").cast("int").alias("op"))


_SOURCE = "src AS (SELECT *, row_number() OVER (ORDER BY point_id) - 1 AS place FROM pts_orders)"
_LOG = "SELECT seq::BIGINT AS seq, point_id, op::INTEGER AS op, weight, x0, x1 FROM log_ JOIN src USING (place)"


@query(q.recursive(ORDERS, _SOURCE, *q.random_log("constant", 200, 0.7, SEED, 300, 5000)) + _LOG)
def win_const(spark, sf_dir):
    return spread(generators.constant_window(pts_orders(spark, sf_dir), 200, 300, 0.7, SEED), 2, "seq", "point_id", "op", "weight").withColumn("op", F.col("op").cast("int"))


@query(q.recursive(ORDERS, _SOURCE, *q.random_log("snake", 200, 0.9, SEED)) + _LOG)
def win_snake(spark, sf_dir):
    return spread(generators.snake_window(pts_orders(spark, sf_dir), 200, SEED), 2, "seq", "point_id", "op", "weight").withColumn("op", F.col("op").cast("int"))


@query("SELECT range AS point_id, floor(range / 100)::DOUBLE AS x0, (range % 100)::DOUBLE AS x1 FROM range(10000)")
def grid(spark, sf_dir):
    return spread(generators.grid(spark, 10_000), 2, "point_id")


@query("SELECT event_id AS old_id, ((event_id // 300) * 100 + event_id % 100)::BIGINT AS point_id FROM events WHERE (event_id // 100) % 3 = 0")
def block_skip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("old_id"))
    return generators.block_skip(rows, F.col("old_id"), size=100).select("old_id", F.col("point_id").cast("long").alias("point_id"))


_HOURS = "([0, 31, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335])[month({0})] * 24 + day({0}) * 24 + hour({0}) + minute({0}) / 60.0::DOUBLE + floor(second({0})) / 3600.0::DOUBLE"


@query(f"""WITH t AS (SELECT event_id AS point_id, ts AS a, ts + INTERVAL 90 MINUTE AS b, value AS lat, -value AS lon FROM events)
SELECT point_id, round({_HOURS.format('a')}, 6) AS start_h, round({_HOURS.format('b')}, 6) AS end_h, round({_HOURS.format('b')} - ({_HOURS.format('a')}), 6) AS dur_h, lat, lon FROM t WHERE a < b""")
def ts_features(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("point_id"), F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 90 MINUTES")).alias("b"), F.col("value").alias("lat"), (-F.col("value")).alias("lon"))
    return generators.trip_features(rows, "a", "b", "lat", "lon").select("point_id", *[F.round(c, 6).alias(c) for c in ("start_h", "end_h", "dur_h")], "lat", "lon")


# log replay

_LIVE = """SELECT point_id, arg_min(weight, seq) AS weight, arg_min(x0, seq) AS x0, arg_min(x1, seq) AS x1, min(seq) AS seq
FROM ops_events o LEFT JOIN (SELECT point_id, max(seq) AS dead FROM ops_events WHERE op = 0 GROUP BY point_id) d USING (point_id)
WHERE op = 1 AND (dead IS NULL OR seq > dead) GROUP BY point_id"""


@query(q.with_(EVENTS) + _LIVE)
def live_set(spark, sf_dir):
    return spread(replay.live_set(ops_events(spark, sf_dir)), 2, "point_id", "weight", "seq").select("point_id", "weight", "x0", "x1", "seq")


@query(
    q.with_(
        EVENTS,
        "last AS (SELECT max(seq) AS last FROM ops_events)",
        "c AS (SELECT unnest(range(0, last + 1, 500)) AS checkpoint FROM last)",
        "d AS (SELECT checkpoint, point_id, max(seq) FILTER (op = 0) AS dead, max(seq) FILTER (op = 1) AS born FROM c JOIN ops_events ON seq <= checkpoint GROUP BY ALL)",
    )
    + "SELECT checkpoint, count(*) AS n_live FROM d WHERE born IS NOT NULL AND (dead IS NULL OR born > dead) GROUP BY checkpoint"
)
def live_at_checkpoints(spark, sf_dir):
    ops = ops_events(spark, sf_dir)
    last = ops.agg(F.max("seq")).first()[0]
    return replay.live_at(ops, 500, last or 0).groupBy("checkpoint").agg(F.count(F.lit(1)).alias("n_live"))


@query(q.with_(EVENTS) + _LIVE)
def stream_apply(spark, sf_dir):
    """The live set kept by a stream of four batches."""
    path = scratch_path(spark, "log")
    maintain.write_log(ops_events(spark, sf_dir), path, 4)
    live, _ = maintain.replay(spark, path)
    return spread(live.read(), 2, "point_id", "weight", "seq").select("point_id", "weight", "x0", "x1", "seq")


@query(q.with_(EVENTS, f"live AS ({_LIVE})") + "SELECT count(*) AS points, sum(floor(weight * 1000))::BIGINT AS w_milli, sum(point_id)::BIGINT AS ids, (sum(floor(weight * 1000)) > 0)::INTEGER AS has_summary FROM live")
def stream_summary(spark, sf_dir):
    """The points and weights in the leaves of the tree kept by the same stream, and whether it has a summary."""
    path = scratch_path(spark, "log")
    maintain.write_log(ops_events(spark, sf_dir), path, 4)
    _, summary = maintain.replay(spark, path, maintain.Settings(k=3, dims=2, size=20))
    some = 0 if summary.rows().isEmpty() else 1
    return summary.tree().level(0).agg(F.count(F.lit(1)).alias("points"), F.sum("w_milli").alias("w_milli"), F.sum("point_id").alias("ids")).withColumn("has_summary", F.lit(some))


_TWENTY = q.draws("one", 20, SEED, "uniform", "unit")


@query(
    q.with_(ORDERS, "unit AS (SELECT point_id, 1.0::DOUBLE AS one FROM pts_orders)", _TWENTY, "s AS (SELECT DISTINCT point_id FROM drawn)", "c AS (SELECT count(*) AS n FROM pts_orders)", "h AS (SELECT count(*) AS hits FROM s)",
            "m AS (SELECT count(*) AS miss FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT point_id FROM s))")
    + "SELECT 'miss' AS deletes, n AS points, miss AS tombstones FROM c, m UNION ALL SELECT 'hit', n - hits, 0 FROM c, h"
)
def lazy_delete(spark, sf_dir):
    """Points and tombstones after deletes that miss the summary, and after deletes that hit it."""
    points = pts_orders(spark, sf_dir)
    summary = coreset.uniform_summary(points, 20, SEED).select("point_id")
    old = table(spark, sf_dir, "orders").where("o_orderdate < timestamp'1996-01-01'").select(F.col("o_orderkey").alias("point_id"))
    miss = old.join(summary, "point_id", "left_anti")
    out = []
    for name, ids in (("miss", miss), ("hit", summary)):
        kept, noted = replay.lazy_delete(points, ids, summary)
        out.append(kept.agg(F.count(F.lit(1)).alias("points")).join(noted.agg(F.count(F.lit(1)).alias("tombstones"))).select(F.lit(name).alias("deletes"), "points", "tombstones"))
    return out[0].unionAll(out[1])


@query("""WITH p AS (SELECT * FROM (VALUES (0.5, 0.1, 3, 2), (0.1, 0.1, 10, 4), (0.2, 0.05, 5, 64), (0.0, 0.1, 3, 2), (0.5, 0.6, 3, 2)) v(eps, lam, k, d))
SELECT eps::DOUBLE AS eps, lam::DOUBLE AS lam, k, d, CASE WHEN eps <= 0 OR lam > 0.5 THEN -1 ELSE floor(5 / (eps::DOUBLE * eps::DOUBLE) * (k * d + ln(1 / lam::DOUBLE)))::BIGINT END AS size FROM p""")
def coreset_size(spark, sf_dir):
    cases = [(0.5, 0.1, 3, 2), (0.1, 0.1, 10, 4), (0.2, 0.05, 5, 64), (0.0, 0.1, 3, 2), (0.5, 0.6, 3, 2)]
    rows = F.array(*[F.struct(F.lit(e).alias("eps"), F.lit(lam).alias("lam"), F.lit(k).alias("k"), F.lit(d).alias("d"), F.lit(coreset.summary_size(e, lam, k, d)).cast("long").alias("size")) for e, lam, k, d in cases])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


# distances


@query(q.with_(q.points("pts_emb")) + "SELECT a.point_id, round(list_sum(list_transform(list_zip(a.coords, b.coords), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d2 FROM pts_emb a, (SELECT coords FROM pts_emb ORDER BY point_id LIMIT 1) b")
def sq_dist(spark, sf_dir):
    points = pts_emb(spark, sf_dir)
    origin = F.array(*map(F.lit, clustering.first_centres(points, 1)[0][1]))
    return points.select("point_id", F.round(geometry.sq_dist(F.col("coords"), origin), 6).alias("d2"))


@query(q.with_(ORDERS, q.first_centres(k=1)) + f"SELECT p.point_id, round(sqrt({q.d2('p', 'c')}), 6) AS d FROM pts_orders p, centres c")
def l2_dist(spark, sf_dir):
    points = pts_orders(spark, sf_dir)
    origin = F.array(*map(F.lit, clustering.first_centres(points, 1)[0][1]))
    return points.select("point_id", F.round(geometry.l2_dist(F.col("coords"), origin), 6).alias("d"))


@query(q.with_(q.points("pts_emb")) + "SELECT point_id, round(list_sum(list_transform(coords, lambda x: x * x)), 6) AS n2 FROM pts_emb")
def sq_norm(spark, sf_dir):
    return pts_emb(spark, sf_dir).select("point_id", F.round(geometry.sq_norm(F.col("coords")), 6).alias("n2"))


@query(q.with_(NATIONS) + f"SELECT a.point_id AS a, b.point_id AS b, round({q.d2('a', 'b')}, 6) AS d2 FROM pts_nation a JOIN pts_nation b ON a.point_id < b.point_id")
def pairwise_sq(spark, sf_dir):
    """All pairs of the nations, a table of fixed size: for enumeration on tiny inputs only."""
    few = pts_nation(spark, sf_dir)
    side = lambda x: few.select(F.col("point_id").alias(x), F.col("coords").alias(f"coords_{x}"))
    return side("a").join(F.broadcast(side("b")), F.col("a") < F.col("b")).select("a", "b", F.round(geometry.sq_dist(F.col("coords_a"), F.col("coords_b")), 6).alias("d2"))


@query(q.with_(ORDERS, q.first_centres(k=1)) + f"SELECT round(2 * sqrt(max({q.d2('p', 'c')})), 4) AS bound FROM pts_orders p, centres c")
def max_dist_bound(spark, sf_dir):
    points = pts_orders(spark, sf_dir)
    return clustering.max_distance_bound(points, clustering.first_centres(points, 1)[0][1]).select(Q("bound").alias("bound"))


# random primitives


@query(f"SELECT o_orderkey AS point_id, {q.u(SEED, 'u', 'o_orderkey')} AS u FROM orders")
def hash_uniform(spark, sf_dir):
    return pts_orders(spark, sf_dir).select("point_id", rng.uniform(SEED, "u", F.col("point_id")).alias("u"))


@query(f"SELECT o_orderkey AS point_id, round(sqrt(-2.0 * ln(1.0 - {q.u(SEED, 'z:a', 'o_orderkey')})) * cos(2.0 * 3.141592653589793 * {q.u(SEED, 'z:b', 'o_orderkey')}), 6) AS z FROM orders")
def hash_normal(spark, sf_dir):
    return pts_orders(spark, sf_dir).select("point_id", F.round(rng.normal(SEED, "z", F.col("point_id")), 6).alias("z"))


@query(f"SELECT o_orderkey AS point_id, (floor(o_totalprice / 1000) + CASE WHEN {q.u(SEED, 'r', 'o_orderkey')} < o_totalprice / 1000 - floor(o_totalprice / 1000) THEN 1 ELSE 0 END)::BIGINT AS rounded FROM orders")
def stoch_round(spark, sf_dir):
    return pts_orders(spark, sf_dir).select("point_id", rng.stochastic_round(F.col("coords")[0], rng.uniform(SEED, "r", F.col("point_id"))).alias("rounded"))


@query(q.with_(ORDERS, q.draws("weight", 1, SEED, "pick", "pts_orders")) + "SELECT point_id FROM drawn")
def weighted_pick(spark, sf_dir):
    return sampling.weighted_sample(pts_orders(spark, sf_dir), F.col("weight"), 1, SEED, "pick").select("point_id")


@query(q.with_(ORDERS, q.draws("weight", DRAWS, SEED, "draw", "pts_orders")) + "SELECT draw_no, point_id FROM drawn")
def weighted_sample(spark, sf_dir):
    return sampling.weighted_sample(pts_orders(spark, sf_dir), F.col("weight"), DRAWS, SEED).select("draw_no", "point_id")


@query(q.with_(ORDERS, "unit AS (SELECT point_id, 1.0::DOUBLE AS one FROM pts_orders)", q.draws("one", DRAWS, SEED, "uniform", "unit")) + "SELECT draw_no, point_id FROM drawn")
def uniform_sample(spark, sf_dir):
    return sampling.uniform_sample(pts_orders(spark, sf_dir), DRAWS, SEED).select("draw_no", "point_id")


@query(q.with_(ORDERS) + f"SELECT {q.BUCKET} AS bucket, sum(weight) AS total FROM pts_orders WHERE point_id % 3 <> 1 GROUP BY 1")
def sample_tree(spark, sf_dir):
    """The sums of a sampling structure over two thirds of the points, after the last third came and a third went."""
    points = pts_orders(spark, sf_dir)
    third = lambda i: points.where(F.col("point_id") % 3 == i)
    before = sampling.bucket_totals(third(0).unionAll(third(1)), F.col("weight"))
    return sampling.merged_totals(before, third(2), third(1), F.col("weight"))


@query(
    q.with_(ORDERS, f"r AS (SELECT *, sum(weight) OVER ({q.ORDER}) AS hi, row_number() OVER ({q.PLACES}) - 1 AS place FROM pts_orders)")
    + f"SELECT slot::BIGINT AS slot, arg_max(point_id, place) AS point FROM (SELECT *, CASE WHEN place < 50 THEN place WHEN {q.u(SEED, 'accept', 'point_id')} < 50 * weight / hi THEN floor({q.u(SEED, 'slot', 'point_id')} * 50) END AS slot FROM r) WHERE slot IS NOT NULL GROUP BY slot"
)
def reservoir(spark, sf_dir):
    return sampling.reservoir(pts_orders(spark, sf_dir), F.col("weight"), 50, SEED).select(F.col("slot").cast("long").alias("slot"), "point")


# assignments and their aggregates


@query(ASSIGNED + "SELECT point_id, cluster_id, round(d2, 4) AS d2 FROM assigned")
def assign(spark, sf_dir):
    return _assigned(spark, sf_dir).select("point_id", "cluster_id", Q("d2").alias("d2"))


@query(
    q.with_(q.points("pts_emb"), "c AS (SELECT (row_number() OVER (ORDER BY point_id) - 1)::INTEGER AS cluster_id, coords FROM (SELECT * FROM pts_emb ORDER BY point_id LIMIT 10))",
            "d AS (SELECT p.point_id, c.cluster_id, list_sum(list_transform(list_zip(p.coords, c.coords), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2 FROM pts_emb p, c)")
    + "SELECT point_id, arg_min(cluster_id, (d2, cluster_id)) AS cluster_id, round(min(d2), 6) AS d2 FROM d GROUP BY point_id"
)
def assign_wide(spark, sf_dir):
    """The form for many dimensions: a fold over the array of centres in each row."""
    points = pts_emb(spark, sf_dir)
    return clustering.assign(points, clustering.first_centres(points, 10)).select("point_id", "cluster_id", F.round("d2", 6).alias("d2"))


@query(ASSIGNED + "SELECT cluster_id, count(*) AS n FROM assigned GROUP BY cluster_id")
def cluster_sizes(spark, sf_dir):
    return clustering.cluster_sizes(_assigned(spark, sf_dir))


@query(ASSIGNED + "SELECT cluster_id, sum(floor(weight * 1000))::BIGINT AS w_milli FROM assigned GROUP BY cluster_id")
def cluster_weights(spark, sf_dir):
    return clustering.cluster_weights(_assigned(spark, sf_dir))


@query(COSTED + "SELECT round(sum(d), 2) AS cost FROM costed")
def total_cost(spark, sf_dir):
    return clustering.total_cost(_assigned(spark, sf_dir)).select(F.round("cost", 2).alias("cost"))


@query(COSTED + "SELECT round(sum(wd), 2) AS cost FROM costed")
def total_wcost(spark, sf_dir):
    return clustering.total_weighted_cost(_assigned(spark, sf_dir)).select(F.round("cost", 2).alias("cost"))


@query(COSTED + "SELECT cluster_id, round(avg(d), 4) AS avg_cost FROM costed GROUP BY cluster_id")
def cluster_avg_cost(spark, sf_dir):
    return clustering.cluster_costs(_assigned(spark, sf_dir)).select("cluster_id", Q("avg_cost").alias("avg_cost"))


@query(COSTED + "SELECT cluster_id, round(sum(d), 2) AS cost FROM costed GROUP BY cluster_id")
def cluster_cost(spark, sf_dir):
    return clustering.cluster_costs(_assigned(spark, sf_dir)).select("cluster_id", F.round("cost", 2).alias("cost"))


@query(COSTED + "SELECT point_id, round(wd / (SELECT sum(wd) FROM costed) * 1000000, 4) AS share FROM costed")
def norm_cost(spark, sf_dir):
    return clustering.normalized_costs(_assigned(spark, sf_dir), "wd").select("point_id", Q(F.col("share") * 1_000_000).alias("share"))


@query(ASSIGNED + "SELECT cluster_id, round(avg(x0), 4) AS c0, round(avg(x1), 4) AS c1 FROM assigned GROUP BY cluster_id")
def cluster_means(spark, sf_dir):
    return clustering.cluster_means(_assigned(spark, sf_dir), 2, weighted=False).select("cluster_id", Q("c0").alias("c0"), Q("c1").alias("c1"))


@query(ASSIGNED + "SELECT cluster_id, round(sum(weight * x0) / sum(weight), 4) AS c0, round(sum(weight * x1) / sum(weight), 4) AS c1 FROM assigned GROUP BY cluster_id")
def cluster_wmeans(spark, sf_dir):
    return clustering.cluster_means(_assigned(spark, sf_dir), 2).select("cluster_id", Q("c0").alias("c0"), Q("c1").alias("c1"))


@query(ASSIGNED + "SELECT point_id FROM assigned WHERE cluster_id = 1")
def cluster_members(spark, sf_dir):
    return clustering.members(_assigned(spark, sf_dir), 1).select("point_id")


@query(ASSIGNED + "SELECT cluster_id, (row_number() OVER (ORDER BY cluster_id) - 1)::INTEGER AS number FROM (SELECT DISTINCT cluster_id FROM assigned)")
def cluster_ids(spark, sf_dir):
    return clustering.cluster_ids(_assigned(spark, sf_dir)).select("cluster_id", F.col("number").cast("int").alias("number"))


# k-means


@query(q.with_(ORDERS, *q.seeds(K, SEED)) + "SELECT step::INTEGER AS step, point_id FROM seeds")
def kmeanspp(spark, sf_dir):
    centres = kmeans.seed_centres(pts_orders(spark, sf_dir), K, SEED)
    rows = F.array(*[F.struct(F.lit(n).alias("step"), F.lit(key).cast("long").alias("point_id")) for n, _, key in centres])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


_CENTRES = "SELECT cluster_id, round(x0, 4) AS c0, round(x1, 4) AS c1 FROM "


def _shown(spark: SparkSession, centres) -> DataFrame:
    return kmeans.centres_frame(spark, centres).select("cluster_id", Q("c0").alias("c0"), Q("c1").alias("c1"))


@query(q.with_(ORDERS, q.first_centres(), *q.lloyd(1)) + _CENTRES + "lloyd_1")
def lloyd_step(spark, sf_dir):
    return _shown(spark, kmeans.lloyd_step(*_five(spark, sf_dir)))


@query(q.with_(ORDERS, q.first_centres(), *q.lloyd(3)) + _CENTRES + "lloyd_3")
def lloyd_3(spark, sf_dir):
    return _shown(spark, kmeans.lloyd(*_five(spark, sf_dir), rounds=3, tolerance=0.0))


_KMEANS = q.recursive(ORDERS, *q.seeds(K, SEED), q.by_id(), *q.converged()) + _CENTRES + "lloyd"


@query(_KMEANS)
def kmeans_(spark, sf_dir):
    """Seeds and rounds until the centres stand still, 300 at most."""
    return _shown(spark, kmeans.kmeans(pts_orders(spark, sf_dir), K, SEED))


QUERIES["kmeans"], SQL["kmeans"] = QUERIES.pop("kmeans_"), SQL.pop("kmeans_")


@query(_KMEANS)
def kmeans_small(spark, sf_dir):
    """The same on rows in memory, as for summaries; by distributed rounds if they are too many."""
    return _shown(spark, small.kmeans(pts_orders(spark, sf_dir), K, SEED, kmeans.ROUNDS, kmeans.TOLERANCE))


@query()
def fast_seed(spark, sf_dir):
    """Fifty seeds by distances in grids."""
    centres = grid_seeding.fast_seeds(pts_orders(spark, sf_dir), 50, 2, SEED)
    rows = F.array(*[F.struct(F.lit(n).alias("step"), F.lit(key).cast("long").alias("point_id")) for n, _, key in centres])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _common_sql(levels: int, extent: float, shift: tuple[float, float]) -> str:
    same = lambda level: " AND ".join(f"floor((p.x{i} + {s}) / {2.0 * extent / (1 << level)}) = floor((c.x{i} + {s}) / {2.0 * extent / (1 << level)})" for i, s in enumerate(shift))
    return "CASE " + " ".join(f"WHEN NOT ({same(level)}) THEN {level - 1}" for level in range(levels + 1)) + f" ELSE {levels} END"


@query(q.with_(ORDERS, q.first_centres(k=1)) + f"SELECT point_id, level::INTEGER AS level, round(2.0 * {2.0 * 1024.0 * 2**0.5!r} * (pow(2.0, -level) - {2.0**-8!r}), 4) AS d FROM (SELECT p.point_id, {_common_sql(8, 1024.0, (300.25, 411.5))} AS level FROM pts_orders p, centres c)")
def tree_dist(spark, sf_dir):
    points = pts_orders(spark, sf_dir)
    origin = F.array(*map(F.lit, clustering.first_centres(points, 1)[0][1]))
    level = grid_seeding.common_level(F.col("coords"), origin, [300.25, 411.5], 1024.0, 8)
    return points.select("point_id", level.alias("level")).select("point_id", "level", Q(grid_seeding.tree_distance(F.col("level"), 1024.0, 2, 8)).alias("d"))


_GRIDS = grid_seeding.Grids(((1300.25, 1411.5), (1007.0, 1803.75)), 1024.0, 8)
_SEED_LEVELS = "greatest(" + ", ".join(_common_sql(8, 1024.0, g) for g in _GRIDS.shifts) + ")"


@query(q.with_(ORDERS, "seeds AS (SELECT * FROM pts_orders ORDER BY point_id LIMIT 4)", "gone AS (SELECT min(point_id) AS point_id FROM seeds)") + f"SELECT p.point_id, max({_SEED_LEVELS})::INTEGER AS level FROM pts_orders p, seeds c WHERE c.point_id NOT IN (SELECT point_id FROM gone) AND p.point_id NOT IN (SELECT point_id FROM gone) AND p.point_id % 5 <> 0 GROUP BY p.point_id")
def seed_update(spark, sf_dir):
    """The deepest level that each point shares with any of four seeds, after points came and went, the first seed among them."""
    points = pts_orders(spark, sf_dir)
    seeds = [(r["point_id"], list(r["coords"])) for r in points.orderBy("point_id").limit(4).collect()]
    state = grid_seeding.Seeding.over(points.where("point_id % 2 = 0"), _GRIDS, seeds).insert(points.where("point_id % 2 = 1"))
    state = state.remove(points.where(F.col("point_id").isin([seeds[0][0]]) | (F.col("point_id") % 5 == 0)).select("point_id"))
    return state.rows.select("point_id", state.levels().alias("level"))


# summaries

_SUMMARY = "SELECT draw_no, point_id, is_center, cluster_id, round(weight, 3) AS weight, round(x0, 3) AS x0, round(x1, 3) AS x1 FROM summary"


def _summary(rows: DataFrame) -> DataFrame:
    out = spread(rows, 2, "draw_no", "point_id", "is_center", "cluster_id", "weight")
    return out.select("draw_no", "point_id", "is_center", "cluster_id", *[F.round(c, 3).alias(c) for c in ("weight", "x0", "x1")])


@query(q.with_(ORDERS, *q.summary(K, DRAWS, SEED, True)) + _SUMMARY)
def coreset_weighted(spark, sf_dir):
    return _summary(coreset.summarize(pts_orders(spark, sf_dir), K, DRAWS, SEED, 2))


@query(q.with_(ORDERS, *q.summary(K, DRAWS, SEED, False)) + _SUMMARY)
def coreset_static(spark, sf_dir):
    return _summary(coreset.summarize(pts_orders(spark, sf_dir), K, DRAWS, SEED, 2, weighted=False))


@query(
    q.with_(ORDERS, q.first_centres(), q.assigned(), "costed AS (SELECT *, sqrt(d2) AS d, weight * sqrt(d2) AS wd FROM assigned)", q.draws("wd", DRAWS, SEED, "sensitivity", "costed"),
            f"s AS (SELECT cluster_id, sum((SELECT sum(wd) FROM costed) / ({DRAWS} * d)) AS drawn FROM drawn GROUP BY cluster_id)")
    + "SELECT cluster_id, round(sum(weight), 3) AS total, round(coalesce(any_value(drawn), 0), 3) AS drawn, round(greatest(0, sum(weight) - coalesce(any_value(drawn), 0)), 3) AS weight FROM assigned LEFT JOIN s USING (cluster_id) GROUP BY cluster_id"
)
def center_weights(spark, sf_dir):
    rows = _assigned(spark, sf_dir)
    out = coreset.centre_weights(rows, coreset.draw(rows, DRAWS, SEED))
    return out.select("cluster_id", *[F.round(c, 3).alias(c) for c in ("total", "drawn", "weight")])


@query(q.with_(ORDERS, "unit AS (SELECT *, 1.0::DOUBLE AS one FROM pts_orders)", q.draws("one", DRAWS, SEED, "uniform", "unit")) + "SELECT draw_no, point_id, weight FROM drawn")
def coreset_uniform(spark, sf_dir):
    return coreset.uniform_summary(pts_orders(spark, sf_dir), DRAWS, SEED).select("draw_no", "point_id", "weight")


@query(q.with_(ORDERS, q.draws("weight", 100, SEED, "proportional", "pts_orders")) + "SELECT draw_no, (draw_no // 10)::INTEGER AS rep, point_id, 1.0::DOUBLE AS weight FROM drawn")
def coreset_prop(spark, sf_dir):
    return coreset.proportional_summary(pts_orders(spark, sf_dir), 10, SEED).select("draw_no", "rep", "point_id", "weight")


# trees


_SHAPE = tree.Shape(leaf=200, size=100, cutoff=150)
_LEVELS = 12  # of the SQL; trees of up to 4,096 leaves
_TREE = (ORDERS, *q.tree("pts_orders", 200, _LEVELS, 3, 100, 150, _SHAPE.seed), q.tree_height())
_SHAPES = "SELECT level, node_id::BIGINT AS node_id, n, w_milli FROM (" + " UNION ALL ".join(f"SELECT {i}::INTEGER AS level, node_id, count(*) AS n, sum(w)::BIGINT AS w_milli FROM lvl_{i} GROUP BY node_id" for i in range(_LEVELS + 1)) + ")"


def _tree(spark: SparkSession, sf_dir: str) -> tree.Tree:
    return tree.build(pts_orders(spark, sf_dir), _SHAPE)


@query(q.with_(ORDERS, q.leaves("pts_orders", 200)) + "SELECT node_id::BIGINT AS node_id, count(*) AS n, sum(w)::BIGINT AS w_milli FROM lvl_0 GROUP BY node_id")
def tree_build(spark, sf_dir):
    """Sizes and weights of the leaves of a new tree."""
    rows = tree.leaves(pts_orders(spark, sf_dir), _SHAPE)
    return rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.sum("w_milli").alias("w_milli"))


@query(q.with_(ORDERS, *q.tree("pts_orders", 200, 1, 3, 100, 150, _SHAPE.seed)) + "SELECT node_id::BIGINT AS node_id, point_id, is_center, w AS w_milli, round(x0, 3) AS x0, round(x1, 3) AS x1 FROM lvl_1")
def tree_reduce(spark, sf_dir):
    """The rows of the first reduced level."""
    rows = spread(_tree(spark, sf_dir).level(1), 2, "node_id", "point_id", "is_center", "w_milli")
    return rows.select("node_id", "point_id", "is_center", "w_milli", *[F.round(c, 3).alias(c) for c in ("x0", "x1")])


@query(q.with_(*_TREE) + _SHAPES + " WHERE level <= (SELECT h FROM height)")
def tree_shape(spark, sf_dir):
    return tree.shape_of(_tree(spark, sf_dir).rows)


@query(q.with_(*_TREE, *q.reduced(f"lvl_{_LEVELS}", "top", "SELECT h + 1 FROM height", 3, 100, 100, _SHAPE.seed)) + "SELECT point_id, is_center, w / 1000 AS weight, round(x0, 3) AS x0, round(x1, 3) AS x1 FROM top")
def tree_coreset(spark, sf_dir):
    rows = spread(tree.summary(_tree(spark, sf_dir)), 2, "point_id", "is_center", "weight")
    return rows.select("point_id", "is_center", "weight", *[F.round(c, 3).alias(c) for c in ("x0", "x1")])


def _leaves_after(leaf: int, gone: str) -> str:
    """Leaves, points and weights after deletes, or under another size of leaves."""
    return q.with_(
        ORDERS, q.leaves("pts_orders", 200),
        f"s AS (SELECT node_id, count(*) AS n0, count(*) FILTER (NOT ({gone})) AS n, coalesce(sum(w) FILTER (NOT ({gone})), 0) AS w FROM lvl_0 JOIN orders ON o_orderkey = point_id GROUP BY node_id)",
        f"t AS (SELECT *, n = 0 OR (n < n0 AND n < {leaf}) OR ({leaf} <> 200 AND n < {leaf}) OR ({leaf} < 200 AND n > 2 * {leaf}) AS short FROM s)",
        f"o AS (SELECT max(node_id) FILTER (n0 < 200 AND n > 0 AND n < {leaf} AND node_id = (SELECT max(node_id) FROM s)) AS open_, min(node_id) FILTER (short AND n > 0 AND n < {leaf}) AS first_ FROM t)",
        "c AS (SELECT coalesce(open_, first_, -1) AS current_ FROM o)",
        f"x AS (SELECT count(*) AS l, sum(n) AS points, sum(w) AS w, coalesce(sum(n) FILTER (short AND node_id <> current_), 0) AS m, count(*) FILTER (short AND node_id <> current_) AS h, coalesce({leaf} - max(n) FILTER (node_id = current_), 0) AS room FROM t, c)",
    ) + f"SELECT (l + greatest(0, ceil((m - room) / {leaf})) - h)::BIGINT AS leaves, points::BIGINT AS points, w::BIGINT AS w_milli FROM x"


def _leaf_totals(t: tree.Tree) -> DataFrame:
    return t.level(0).agg(F.countDistinct("node_id").alias("leaves"), F.count(F.lit(1)).alias("points"), F.sum("w_milli").alias("w_milli"))


def _before(spark: SparkSession, sf_dir: str, date: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(f"o_orderdate < timestamp'{date}'").select(F.col("o_orderkey").alias("point_id"))


@query(_leaves_after(200, "o_orderdate < TIMESTAMP '1996-01-01'"))
def tree_delete(spark, sf_dir):
    """The leaves after deletes: small ones are merged, the last ones take free numbers."""
    return _leaf_totals(tree.delete(_tree(spark, sf_dir), _before(spark, sf_dir, "1996-01-01")))


@query(q.with_(ORDERS) + "SELECT ceil(count(*) / 200)::BIGINT AS leaves, count(*) AS points, sum(floor(weight * 1000))::BIGINT AS w_milli FROM pts_orders")
def tree_insert(spark, sf_dir):
    """The leaves after inserts: the open one is filled before new ones."""
    points = pts_orders(spark, sf_dir)
    return _leaf_totals(tree.insert(tree.build(points.where("point_id % 3 <> 0"), _SHAPE), points.where("point_id % 3 = 0")))


@query(_leaves_after(60, "false"))
def tree_rebalance(spark, sf_dir):
    """The leaves under a smaller size: those above twice of it are dealt anew."""
    return _leaf_totals(tree.rebalance(_tree(spark, sf_dir), tree.Shape(leaf=60, size=30, cutoff=30)))


#: Height and arity of the six fixed-height trees.
FLAT = ((3, 10), (4, 6), (5, 4), (6, 3), (7, 3), (8, 2))


_CAPACITY = "CASE WHEN l = 1 THEN 1 ELSE greatest(1, floor(l * f)) END"
_FLAT_LEAVES = "SELECT row_number() OVER ({places}) - 1 AS place, *, (SELECT min(l) FROM (SELECT range AS l, 1.0 AS f FROM range(1, 100000)) WHERE l * {cap} >= (SELECT count(*) FROM {points})) AS l, 1.0 AS f FROM {points}"


def _flat_build(height: int, arity: int) -> None:
    first = "lvl_0 AS MATERIALIZED (SELECT place // (" + _CAPACITY + ")::BIGINT AS node_id, point_id, false AS is_center, floor(weight * 1000)::BIGINT AS w, x0, x1 FROM (" + _FLAT_LEAVES.format(places=q.PLACES, cap=_CAPACITY, points="pts_orders") + "))"
    levels = q.tree("pts_orders", 1, height - 1, 3, 100, 100, 7, arity, height)
    shapes = " UNION ALL ".join(f"SELECT {i}::INTEGER AS level, node_id::BIGINT AS node_id, count(*) AS n, sum(w)::BIGINT AS w_milli FROM lvl_{i} GROUP BY node_id" for i in range(height))

    def run(spark, sf_dir):
        points = pts_orders(spark, sf_dir)
        return tree.shape_of(tree.build(points, tree.flat_shape(points.count(), height, arity, size=100, cutoff=100)).rows)

    name = "flat_tree_build" if height == 4 else f"flat_tree_h{height}"
    QUERIES[name], SQL[name] = run, q.with_(ORDERS, first, *levels[1:]) + shapes


for _height, _arity in FLAT:
    _flat_build(_height, _arity)


@query(
    q.with_(ORDERS, f"caps AS (SELECT l, l * {_CAPACITY} AS takes, {_CAPACITY} AS cap FROM (SELECT range AS l, 1.0 AS f FROM range(1, 100000)))",
            "c AS (SELECT count(*) AS n, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS late, count(*) FILTER (point_id % 4 <> 0) AS n0 FROM pts_orders JOIN orders ON o_orderkey = point_id)",
            "l0 AS (SELECT ceil(n0 / (SELECT cap FROM caps WHERE takes >= n0 ORDER BY l LIMIT 1)) AS l0 FROM c)", "l1 AS (SELECT min(l) AS l1 FROM caps, c, l0 WHERE l >= l0 AND takes >= n)",
            "l2 AS (SELECT max(l) AS l2 FROM caps, c, l1 WHERE l <= l1 AND (l = 1 OR (l - 1) * (SELECT cap FROM caps b WHERE b.l = caps.l - 1) <= late))")
    + "SELECT l1::BIGINT AS leaves, n AS points, 1::BIGINT AS fits, 'insert' AS step FROM c, l1 UNION ALL SELECT l2::BIGINT, late, 1, 'delete' FROM c, l2"
)
def flat_tree_delete(spark, sf_dir):
    """Leaves of a fixed-height tree that grows with inserts and shrinks with deletes; no leaf is above its capacity."""
    points = pts_orders(spark, sf_dir)
    some = points.where("point_id % 4 <> 0")
    grown = tree.insert(tree.build(some, tree.flat_shape(some.count(), 3, 10, size=100, cutoff=100)), points.where("point_id % 4 = 0"))
    less = tree.delete(grown, _before(spark, sf_dir, "1998-01-01"))
    out = []
    for name, t in (("insert", grown), ("delete", less)):
        sizes = t.level(0).groupBy("node_id").count()
        most = F.max("count") <= tree.leaf_capacity(t.leaves, 1.0)
        out.append(sizes.agg(F.lit(t.leaves).cast("long").alias("leaves"), F.sum("count").alias("points"), most.cast("long").alias("fits"), F.lit(name).alias("step")))
    return out[0].unionAll(out[1])




@query(f"SELECT n, f::DOUBLE AS factor, min(l)::BIGINT AS leaves FROM (SELECT range AS n FROM range(1, 61)), (VALUES (1.0), (0.5)) v(f), (SELECT range AS l FROM range(1, 61)) WHERE l * {_CAPACITY} >= n GROUP BY n, f")
def flat_capacity(spark, sf_dir):
    rows = spark.range(1, 61).select(F.col("id").alias("n"), F.explode(F.array(F.lit(1.0), F.lit(0.5))).alias("factor"))
    return rows.select("n", "factor", tree.leaf_count_column(F.col("n"), F.col("factor")).alias("leaves"))


# metrics and baselines

_COSTS = "SELECT round(sum(weight * d2) / 1000, 2) AS cost, sum(weight) AS weight, round(sum(weight * d2) / sum(weight), 4) AS avg_cost FROM assigned"


@query(ASSIGNED + "SELECT round(sum(weight * d2) / 1000, 2) AS cost FROM assigned")
def sq_cost(spark, sf_dir):
    return metrics.sq_cost(*_five(spark, sf_dir)).select(F.round(F.col("cost") / 1000, 2).alias("cost"))


@query(ASSIGNED + "SELECT round(sum(weight * d2) / sum(weight), 4) AS avg_cost FROM assigned")
def avg_cost(spark, sf_dir):
    return metrics.sq_cost(*_five(spark, sf_dir)).select(Q("avg_cost").alias("avg_cost"))


@query(
    q.with_(q.points("pts_emb"), "e AS (SELECT point_id, label, unnest(coords) AS x, unnest(range(len(coords))) AS i FROM pts_emb)", "m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i)",
            "d AS (SELECT point_id, m.label, sum((x - m) * (x - m)) AS d2 FROM e JOIN m USING (i) GROUP BY point_id, m.label)", "b AS (SELECT point_id, min(d2) AS d2 FROM d GROUP BY point_id)")
    + "SELECT round(sum(d2), 4) AS cost FROM b"
)
def label_cost(spark, sf_dir):
    return metrics.label_cost(pts_emb(spark, sf_dir), 64).select(Q("cost").alias("cost"))


PAIRS = 10_000


def _rand_sql(rows: str) -> str:
    return f"""n AS (SELECT *, row_number() OVER ({q.PLACES}) - 1 AS at FROM {rows}),
pairs AS (SELECT floor({q.u(SEED, 'left', 'range')} * c)::BIGINT AS a, floor({q.u(SEED, 'right', 'range')} * c)::BIGINT AS b FROM range({PAIRS}), (SELECT count(*) AS c FROM n))
SELECT round(coalesce(sum(CASE WHEN (x.p = y.p) = (x.q = y.q) THEN x.weight + y.weight ELSE 0 END) / sum(x.weight + y.weight), 0), 6) AS rand_index FROM pairs JOIN n x ON x.at = a JOIN n y ON y.at = b"""


@query(
    q.with_(ORDERS, q.first_centres(), q.assigned(), *q.lloyd(1), q.assigned(centres="lloyd_1", name="other"),
            "both_ AS (SELECT a.point_id, a.weight, a.cluster_id AS p, o.cluster_id AS q FROM assigned a JOIN other o USING (point_id))").rstrip("\n")
    + ",\n" + _rand_sql("both_")
)
def rand_index(spark, sf_dir):
    points, centres = _five(spark, sf_dir)
    rows = clustering.assign(points, centres).withColumnRenamed("cluster_id", "p").drop("d2")
    rows = clustering.assign(rows, kmeans.lloyd_step(points, centres)).withColumnRenamed("cluster_id", "q")
    return metrics.rand_index(rows, "p", "q", PAIRS, SEED).select(F.round("rand_index", 6).alias("rand_index"))


@query(
    q.with_(q.points("pts_emb"), "c AS (SELECT (row_number() OVER (ORDER BY point_id) - 1)::INTEGER AS cluster_id, coords FROM (SELECT * FROM pts_emb ORDER BY point_id LIMIT 10))",
            "d AS (SELECT p.point_id, p.weight, p.label, c.cluster_id, list_sum(list_transform(list_zip(p.coords, c.coords), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2 FROM pts_emb p, c)",
            "both_ AS (SELECT point_id, any_value(weight) AS weight, any_value(label) AS q, arg_min(cluster_id, (d2, cluster_id)) AS p FROM d GROUP BY point_id)").rstrip("\n")
    + ",\n" + _rand_sql("both_")
)
def rand_index_labels(spark, sf_dir):
    points = pts_emb(spark, sf_dir)
    rows = clustering.assign(points, clustering.first_centres(points, 10))
    return metrics.rand_index(rows, "cluster_id", "label", PAIRS, SEED).select(F.round("rand_index", 6).alias("rand_index"))


_SUM_POINTS = "sum_points AS (SELECT coalesce(draw_no, 1099511627776 + cluster_id) AS point_id, weight, x0, x1 FROM summary)"
_SOLVED = [*q.seeds(K, SEED, "sum_points", name="xs"), q.by_id("xs", "xc"), *q.converged("sum_points", "xc", name="xl")]
_SOLUTIONS = [
    ORDERS, *q.summary(K, DRAWS, SEED, True), _SUM_POINTS, *_SOLVED,
    *q.seeds(K, SEED, "pts_orders", name="ts"), q.by_id("ts", "tc"), *q.converged("pts_orders", "tc", name="tl"),
    *[q.assigned(points, f"{c}l", f"{c}on{t}") for c in "xt" for t, points in (("x", "sum_points"), ("t", "pts_orders"))],
    "v AS (SELECT " + ", ".join(f"(SELECT sum(weight * d2) / sum(weight) FROM {c}on{t}) AS {c}{t}" for c in "xt" for t in "xt") + ")",
]


def _solution_costs(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Average costs of the solutions on the table (t) and on its summary (x), on both."""
    points = pts_orders(spark, sf_dir)
    sets = {"x": materialize(baselines.numbered_summary(coreset.summarize(points, K, DRAWS, SEED, 2)), "summary"), "t": points}
    centres = {"x": small.kmeans(sets["x"], K, SEED, kmeans.ROUNDS, kmeans.TOLERANCE), "t": kmeans.kmeans(points, K, SEED)}
    costs = {c + t: kmeans.sq_cost(on, centres[c]) for c in centres for t, on in sets.items()}
    return {name: cost / weight for name, (cost, weight) in costs.items()}


@query(q.recursive(*_SOLUTIONS) + "SELECT round(greatest(tt / tx, tx / tt, xx / xt, xt / xx), 5) AS distortion FROM v")
def distortion(spark, sf_dir):
    v = _solution_costs(spark, sf_dir)
    return spark.range(1).select(F.round(F.lit(metrics.distortion(v["tt"], v["tx"], v["xx"], v["xt"])), 5).alias("distortion"))


@query(q.recursive(*_SOLUTIONS) + "SELECT round(tt / xt, 5) AS quality FROM v")
def quality(spark, sf_dir):
    v = _solution_costs(spark, sf_dir)
    return spark.range(1).select(F.round(F.lit(metrics.quality(v["tt"], v["xt"])), 5).alias("quality"))


@query(_KMEANS)
def kmeans_full(spark, sf_dir):
    return _shown(spark, baselines.kmeans_full(pts_orders(spark, sf_dir), K, SEED))


@query(q.recursive(ORDERS, *q.summary(K, DRAWS, SEED, False), _SUM_POINTS, *_SOLVED) + _CENTRES + "xl")
def kmeans_static(spark, sf_dir):
    return _shown(spark, baselines.kmeans_summary(pts_orders(spark, sf_dir), K, DRAWS, SEED, 2, weighted=False))


@query(q.recursive(ORDERS, *q.summary(K, DRAWS, SEED, True), _SUM_POINTS, *_SOLVED) + _CENTRES + "xl")
def kmeans_summary(spark, sf_dir):
    return _shown(spark, baselines.kmeans_summary(pts_orders(spark, sf_dir), K, DRAWS, SEED, 2))


def _random_sql(weight: str, kept: str) -> str:
    return q.recursive(ORDERS, "unit AS (SELECT *, 1.0::DOUBLE AS one FROM pts_orders)", q.draws(weight, DRAWS, SEED, "uniform" if weight == "one" else "proportional", "unit"), f"r AS (SELECT draw_no AS point_id, {kept} AS weight, x0, x1 FROM drawn)",
                       *q.seeds(K, SEED, "r", name="xs"), q.by_id("xs", "xc"), *q.converged("r", "xc", name="xl")) + _CENTRES + "xl"


@query(_random_sql("one", "weight"))
def kmeans_random(spark, sf_dir):
    return _shown(spark, baselines.kmeans_random(pts_orders(spark, sf_dir), K, DRAWS, SEED))


@query(_random_sql("weight", "1.0::DOUBLE"))
def kmeans_random_prop(spark, sf_dir):
    return _shown(spark, baselines.kmeans_random(pts_orders(spark, sf_dir), K, DRAWS, SEED, proportional=True))


_REGIONS = (NATIONS, q.points("pts_region"), "few AS (SELECT *, row_number() OVER (ORDER BY point_id) - 1 AS i FROM pts_region)")


@query(
    q.with_(*_REGIONS, "s AS (SELECT a.point_id AS a, b.point_id AS b, sum(p.weight * least(" + q.d2("p", "a") + ", " + q.d2("p", "b") + ")) AS cost FROM few a JOIN few b ON a.i < b.i CROSS JOIN few p GROUP BY a.point_id, b.point_id)")
    + "SELECT a, b, round(cost, 4) AS cost FROM s ORDER BY s.cost, a, b LIMIT 1"
)
def exact_medoids(spark, sf_dir):
    return baselines.exact_medoids(pts_region(spark, sf_dir), 2).select(F.col("centres")[0].alias("a"), F.col("centres")[1].alias("b"), Q("cost").alias("cost"))


@query(
    q.with_(*_REGIONS, "n AS (SELECT count(*) AS n FROM few)", "g AS (SELECT unnest(range((2 ** n)::BIGINT)) AS labelling FROM n)",
            "c AS (SELECT labelling, (labelling >> i::INTEGER) % 2 AS c, sum(weight * (x0 * x0 + x1 * x1)) - (sum(weight * x0) * sum(weight * x0) + sum(weight * x1) * sum(weight * x1)) / sum(weight) AS cost FROM g, few GROUP BY 1, 2)",
            "t AS (SELECT labelling, round(sum(cost), 4) AS cost FROM c GROUP BY labelling)")
    + "SELECT labelling, cost FROM t ORDER BY cost, labelling LIMIT 1"
)
def exact_kmeans(spark, sf_dir):
    return baselines.exact_kmeans(pts_region(spark, sf_dir), 2)


@query()
def report(spark, sf_dir):
    """The report on a log that slides over the orders, at each quarter of it."""
    from driftsum.plans.report import experiment

    ops = materialize(generators.sliding_window(pts_orders(spark, sf_dir), WINDOW, P, SEED), "report-log")
    every = max(1, (ops.agg(F.max("seq")).first()[0] or 0) // 4)
    return experiment(ops, maintain.Settings(k=K, dims=2, size=DRAWS, cutoff_factor=2.0, insertion_factor=2.0, remove_factor=0.05, seed=SEED), every, checkpoints=4)
