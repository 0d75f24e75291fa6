"""Every registered query of the core against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from driftsum.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(rows):
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([number(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    other = [[r[names.index(c)] for c in columns] for r in result.fetchall()]
    assert plain([[r[c] for c in columns] for r in df.collect()]) == plain(other)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_report_covers_the_log_from_maintained_trees(spark):
    from driftsum.plans import report
    from driftsum.streaming.maintain import Settings

    assert report.positions(1050, 500) == [0, 500, 1000] and report.positions(1050, 500, 80) == [79, 500, 1000] and report.positions(5, 10) == [0]
    ops = queries.generators.sliding_window(queries.pts_orders(spark, SF), queries.WINDOW, queries.P, queries.SEED)
    rows = report.experiment(ops, Settings(k=3, dims=2, size=100, cutoff_factor=2.0, insertion_factor=2.0, remove_factor=0.1), every=1000, checkpoints=1, first=400).collect()
    assert [r["op"] for r in rows] == [2000]
    for r in rows:
        assert r["t_c"] > 0 and all(0.3 < r[f"{x}k_q"] < 1.5 for x in "dos") and r["dc_t"] > 0 and r["oc_t"] > 0, r
    assert report.experiment(ops.limit(0), Settings(k=3, dims=2, size=100), every=10).collect() == []


def test_trees_above_twelve_levels_equal_sql(spark, duck):
    """The registered SQL of the trees ends at level 12; the same SQL with a level more holds for 5,000 leaves."""
    from driftsum.operators import tree
    from driftsum.plans import sql as q
    from driftsum.sources.points import pts_orders

    folder = "/root/testdata/sf0.01"
    shape = tree.Shape(leaf=3, size=20, cutoff=30)
    built = tree.build(pts_orders(spark, folder), shape)
    assert built.height == queries._LEVELS + 1
    path = f"{folder}/orders.parquet"
    orders = f"orders AS (SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}')"
    levels = (orders, queries.ORDERS, *q.tree("pts_orders", 3, 13, 3, 20, 30, shape.seed), q.tree_height())
    sizes = " UNION ALL ".join(f"SELECT {i} AS level, node_id, count(*) AS n, sum(w) AS w FROM lvl_{i} GROUP BY node_id" for i in range(14))
    assert plain(tree.shape_of(built.rows).collect()) == plain([map(int, r) for r in duck.execute(q.with_(*levels) + sizes).fetchall()])
    top = duck.execute(q.with_(*levels, *q.reduced("lvl_13", "top", "SELECT h + 1 FROM height", 3, 20, 20, shape.seed)) + "SELECT point_id, is_center, w / 1000, round(x0, 3), round(x1, 3) FROM top").fetchall()
    rows = tree.summary(built).select("point_id", "is_center", "weight", *[F.round(F.col("coords")[i], 3) for i in range(2)]).collect()
    assert plain(rows) == plain(top)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
