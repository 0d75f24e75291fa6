"""Pieces of DuckDB SQL that restate the operators, for the checks against a second engine."""

from __future__ import annotations

from driftsum.sources.points import SQL as POINTS

BUCKET = "('0x' || substr(md5(point_id::VARCHAR), 1, 4))::INTEGER"
PLACES = f"ORDER BY {BUCKET}, point_id"
ORDER = f"{PLACES} ROWS UNBOUNDED PRECEDING"


def u(seed: int, tag: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:{tag}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def d2(p: str, c: str, dims: int = 2) -> str:
    return " + ".join(f"({p}.x{i} - {c}.x{i}) * ({p}.x{i} - {c}.x{i})" for i in range(dims))


def xs(dims: int = 2, prefix: str = "") -> str:
    return ", ".join(f"{prefix}x{i}" for i in range(dims))


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def first_centres(points: str = "pts_orders", k: int = 5, dims: int = 2, name: str = "centres") -> str:
    return f"{name} AS (SELECT (row_number() OVER (ORDER BY point_id) - 1)::INTEGER AS cluster_id, {xs(dims)} FROM (SELECT * FROM {points} ORDER BY point_id LIMIT {k}))"


def assigned(points: str = "pts_orders", centres: str = "centres", name: str = "assigned", dims: int = 2) -> str:
    d = d2("p", "c", dims)
    return f"""{name} AS (SELECT p.point_id, p.weight, {xs(dims, 'p.')}, arg_min(c.cluster_id, ({d}, c.cluster_id)) AS cluster_id, min({d}) AS d2
      FROM {points} p, {centres} c GROUP BY p.point_id, p.weight, {xs(dims, 'p.')})"""


def seeds(k: int, seed: int, points: str = "pts_orders", dims: int = 2, name: str = "seeds") -> list[str]:
    """k-means++ as one expression for each round; {name}: step, point_id, coordinates."""
    out = []
    for i in range(k):
        near = [d2("p", f"{name}_{j}", dims) for j in range(i)]
        w = "p.weight" if not near else f"p.weight * {near[0]}" if len(near) == 1 else f"p.weight * least({', '.join(near)})"
        w = w if len(near) != 1 else f"p.weight * ({near[0]})"
        tables = "".join(f", {name}_{j}" for j in range(i))
        out.append(f"""{name}_{i} AS MATERIALIZED (SELECT point_id, {xs(dims)} FROM (SELECT *, sum(w) OVER ({ORDER}) AS hi, sum(w) OVER () AS everything
      FROM (SELECT p.point_id, {xs(dims, 'p.')}, {w} AS w FROM {points} p{tables})) WHERE w > 0 AND hi > everything * {u(seed, 'seed', str(i))} {PLACES} LIMIT 1)""")
    union = " UNION ALL ".join(f"SELECT {i} AS step, * FROM {name}_{i}" for i in range(k))
    return [*out, f"{name} AS ({union})"]


def by_id(source: str = "seeds", name: str = "centres", dims: int = 2) -> str:
    return f"{name} AS (SELECT (row_number() OVER (ORDER BY point_id) - 1)::INTEGER AS cluster_id, {xs(dims)} FROM {source})"


def _means(dims: int) -> str:
    return ", ".join(f"coalesce(sum(a.weight * a.x{j}) / nullif(sum(a.weight), 0), any_value(c.x{j})) AS x{j}" for j in range(dims))


def lloyd(rounds: int, points: str = "pts_orders", centres: str = "centres", dims: int = 2, name: str = "lloyd") -> list[str]:
    """{name}_i are the centres after i rounds; {name}_0 is the start."""
    out = [f"{name}_0 AS (SELECT * FROM {centres})"]
    for i in range(rounds):
        out.append(assigned(points, f"{name}_{i}", f"{name}_a{i}", dims))
        out.append(f"{name}_{i + 1} AS MATERIALIZED (SELECT c.cluster_id, {_means(dims)} FROM {name}_{i} c LEFT JOIN {name}_a{i} a USING (cluster_id) GROUP BY c.cluster_id)")
    return out


def converged(points: str = "pts_orders", centres: str = "centres", dims: int = 2, name: str = "lloyd", rounds: int = 300, tolerance: float = 1e-4) -> list[str]:
    """{name} are the centres after Lloyd's rounds: until they move less than the tolerance, or ``rounds`` were made. Needs WITH RECURSIVE."""
    d, x = d2("p", "c", dims), xs(dims, "p.")
    square = " + ".join(f"(n.x{j} - o.x{j}) * (n.x{j} - o.x{j})" for j in range(dims))
    return [
        f"""{name}_r AS (SELECT 0 AS round_, 1e300::DOUBLE AS moved, cluster_id, {xs(dims)} FROM {centres}
      UNION ALL SELECT n.round_ + 1, sqrt(sum({square}) OVER ()), n.cluster_id, {xs(dims, 'n.')} FROM
      (SELECT any_value(c.round_) AS round_, c.cluster_id, {_means(dims)} FROM {name}_r c LEFT JOIN
        (SELECT p.point_id, any_value(p.weight) AS weight, {', '.join(f'any_value(p.x{j}) AS x{j}' for j in range(dims))}, arg_min(c.cluster_id, ({d}, c.cluster_id)) AS cluster_id
         FROM {points} p, {name}_r c GROUP BY p.point_id) a USING (cluster_id) WHERE c.moved >= {tolerance} AND c.round_ < {rounds} GROUP BY c.cluster_id) n
      JOIN {name}_r o USING (cluster_id))""",
        f"{name} AS MATERIALIZED (SELECT cluster_id, {xs(dims)} FROM {name}_r WHERE round_ = (SELECT max(round_) FROM {name}_r))",
    ]


def draws(weight: str, k: int, seed: int, tag: str, rows: str, name: str = "drawn") -> str:
    """k rows of ``rows`` with replacement by ``weight``, with draw_no."""
    return f"""{name} AS (SELECT d.draw_no, r.* FROM (SELECT range AS draw_no, {u(seed, tag, 'range')} AS u FROM range({k})) d
      JOIN (SELECT *, sum({weight}) OVER ({ORDER}) AS hi_, sum({weight}) OVER () AS all_ FROM {rows}) r
      ON d.u * r.all_ >= r.hi_ - r.{weight} AND d.u * r.all_ < r.hi_)"""


def summary(k: int, n: int, seed: int, weighted: bool, points: str = "pts_orders", dims: int = 2) -> list[str]:
    """summary: draw_no, point_id, is_center, cluster_id, weight, coordinates."""
    cost = "wd" if weighted else "d"
    w = "weight" if weighted else "1.0::DOUBLE"
    means = ", ".join(f"sum({w} * x{i}) / sum({w}) AS x{i}" for i in range(dims))
    return [
        *seeds(k, seed, points, dims), by_id(dims=dims), assigned(points, dims=dims),
        "costed AS (SELECT *, sqrt(d2) AS d, weight * sqrt(d2) AS wd FROM assigned)",
        draws(cost, n, seed, "sensitivity", "costed"),
        f"sampled AS (SELECT draw_no, point_id, cluster_id, (SELECT sum({cost}) FROM costed) / ({n} * d) AS weight, {xs(dims)} FROM drawn)",
        f"totals AS (SELECT cluster_id, sum({w}) AS total, {means} FROM assigned GROUP BY cluster_id)",
        "open_ AS (SELECT cluster_id, sum(weight) AS drawn FROM sampled GROUP BY cluster_id)",
        f"""summary AS (SELECT draw_no, point_id, false AS is_center, cluster_id, weight, {xs(dims)} FROM sampled
      UNION ALL SELECT NULL, -1, true, cluster_id, greatest(0.0::DOUBLE, total - coalesce(drawn, 0)), {xs(dims)} FROM totals LEFT JOIN open_ USING (cluster_id))""",
    ]


def leaves(points: str, leaf: int, name: str = "lvl") -> str:
    """{name}_0: the leaves of a new tree."""
    return f"{name}_0 AS MATERIALIZED (SELECT (row_number() OVER ({PLACES}) - 1) // {leaf} AS node_id, point_id, false AS is_center, floor(weight * 1000)::BIGINT AS w, x0, x1 FROM {points})"


def reduced(source: str, name: str, level: str, k: int, size: int, cutoff: int, seed: int) -> list[str]:
    """{name}: the nodes of ``source`` (node_id, point_id, is_center, w, x0, x1), those of more than ``cutoff`` rows reduced as operators.small does."""
    node = f"({level}) || ':' || node_id"
    out = [f"""{name}_b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY point_id, x0, x1, w) - 1 AS r FROM
      (SELECT *, count(*) OVER (PARTITION BY node_id) AS n_ FROM {source}) WHERE n_ > {cutoff})"""]
    for i in range(k):
        share = "b.w::DOUBLE" if i == 0 else f"b.w * {d2('b', 'c0')}" if i == 1 else f"b.w * least({', '.join(d2('b', f'c{j}') for j in range(i))})"
        share = f"b.w * ({d2('b', 'c0')})" if i == 1 else share
        joins = "".join(f" JOIN {name}_c{j} c{j} USING (node_id)" for j in range(i))
        out.append(f"""{name}_c{i} AS MATERIALIZED (SELECT node_id, min(r) AS r, arg_min(x0, r) AS x0, arg_min(x1, r) AS x1 FROM
      (SELECT *, sum(s) OVER (PARTITION BY node_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS cum, sum(s) OVER (PARTITION BY node_id) AS tot FROM
        (SELECT node_id, b.r, b.x0, b.x1, {share} AS s FROM {name}_b b{joins}))
      WHERE tot > 0 AND cum > tot * {u(seed, 'centre', node + f" || ':{i}'")} GROUP BY node_id)""")
    union = " UNION ALL ".join(f"SELECT * FROM {name}_c{i}" for i in range(k))
    d = d2("b", "c")
    out += [
        f"{name}_c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY r) - 1 AS cid, count(*) OVER (PARTITION BY node_id) AS nc FROM ({union}))",
        f"""{name}_a AS MATERIALIZED (SELECT *, sum(cost) OVER (PARTITION BY node_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS cum, sum(cost) OVER (PARTITION BY node_id) AS tot FROM
      (SELECT node_id, b.r, any_value(b.point_id) AS point_id, any_value(b.w) AS w, any_value(b.x0) AS x0, any_value(b.x1) AS x1, any_value(c.nc) AS nc, arg_min(c.cid, ({d}, c.cid)) AS cid, any_value(b.w) * sqrt(min({d})) AS cost, sqrt(min({d})) AS d
       FROM {name}_b b JOIN {name}_c c USING (node_id) GROUP BY node_id, b.r))""",
        f"{name}_p AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY node_id ORDER BY r), 0) AS low FROM {name}_a)",
        f"""{name}_d AS MATERIALIZED (SELECT p.node_id, p.point_id, p.cid, p.x0, p.x1, floor(p.tot / (({size} - p.nc) * p.d))::BIGINT AS w FROM {name}_p p
      JOIN (SELECT node_id, j, any_value(tot) * {u(seed, "draw:' || " + node + " || '", 'j')} AS at FROM {name}_a, (SELECT range AS j FROM range({size})) WHERE j < {size} - nc AND tot > 0 GROUP BY node_id, j) q
      ON q.node_id = p.node_id AND q.at >= p.low AND q.at < p.cum)""",
        f"{name}_t AS (SELECT node_id, cid, sum(w) AS w, sum(w * x0) / sum(w) AS x0, sum(w * x1) / sum(w) AS x1 FROM {name}_a GROUP BY node_id, cid)",
        f"{name}_o AS (SELECT node_id, cid, sum(w) AS w FROM {name}_d GROUP BY node_id, cid)",
        f"""{name} AS MATERIALIZED (SELECT node_id, point_id, is_center, w, x0, x1 FROM (SELECT *, count(*) OVER (PARTITION BY node_id) AS n_ FROM {source}) WHERE n_ <= {cutoff}
      UNION ALL SELECT node_id, point_id, false, w, x0, x1 FROM {name}_d
      UNION ALL SELECT t.node_id, -1, true, greatest(0, t.w - coalesce(o.w, 0))::BIGINT, t.x0, t.x1 FROM {name}_t t LEFT JOIN {name}_o o USING (node_id, cid) WHERE t.w > 0)""",
    ]
    return out


def tree(points: str, leaf: int, levels: int, k: int, size: int, cutoff: int, seed: int, fan: int = 2, height: int | None = None, name: str = "lvl") -> list[str]:
    """{name}_0 up to {name}_levels; the levels above the root repeat it. With ``height``, a tree of that many levels whose leaves are reduced first."""
    out = [leaves(points, leaf, name)]
    below = f"{name}_0"
    for level in range(1, levels + 1):
        if height and level == 1:
            out += reduced(below, f"{name}_leaf", "0", k, size, cutoff, seed)
            below = f"{name}_leaf"
        up = "0" if height and level == height - 1 else f"node_id // {fan}"
        out.append(f"{name}_s{level} AS (SELECT * REPLACE ({up} AS node_id) FROM {below})")
        out += reduced(f"{name}_s{level}", f"{name}_{level}", str(level), k, size, cutoff, seed)
        below = f"{name}_{level}"
    return out


def tree_height(name: str = "lvl", fan: int = 2) -> str:
    return f"height AS (SELECT min(range) AS h FROM range(60), (SELECT count(DISTINCT node_id) AS leaves FROM {name}_0) WHERE {fan}::BIGINT ** range >= leaves)"


def random_log(kind: str, window: int, p: float, seed: int, total: int = 0, steps: int = 0, low: float = 0.2) -> list[str]:
    """log_: seq, place, op of a log with random victims, step by step. Needs WITH RECURSIVE."""
    coin, victim = u(seed, "coin", "seq"), u(seed, "victim", "seq")
    if kind == "constant":
        turn = f"CASE WHEN phase = 1 AND len(live) > {total} THEN 2 WHEN phase = 2 AND j >= {steps} THEN 3 WHEN phase = 3 AND j >= {steps} THEN 4 ELSE phase END"
        ins = f"CASE ph WHEN 1 THEN {coin} < {p} WHEN 2 THEN jj % 2 = 0 ELSE {coin} >= {p} END"
    else:
        turn = f"CASE WHEN phase = 1 AND len(live) <= {low} * {window} THEN 2 WHEN phase = 2 AND len(live) >= {window} THEN 1 ELSE phase END"
        ins = f"CASE ph WHEN 1 THEN {coin} >= {p} ELSE {coin} < {p} END"
    return [
        f"n AS (SELECT count(*) AS n, least({window + 1}, count(*)) AS first FROM orders)",
        f"""walk AS (SELECT first AS seq, first AS following, range(first) AS live, -1::BIGINT AS place, -1 AS op, 1 AS phase, 0 AS j FROM n WHERE n > {window}
      UNION ALL SELECT seq + 1, following + ins, CASE WHEN ins = 1 THEN list_append(live, following) WHEN i = len(live) - 1 THEN live[:i] ELSE list_concat(list_append(live[:i], live[len(live)]), live[i + 2:len(live) - 1]) END,
        CASE WHEN ins = 1 THEN following ELSE live[i + 1] END, ins, ph, jj + 1 FROM
      (SELECT *, ({ins})::INTEGER AS ins, floor({victim} * len(live))::BIGINT AS i FROM
        (SELECT *, {turn} AS ph, CASE WHEN ({turn}) = phase THEN j ELSE 0 END AS jj FROM walk)), n
      WHERE ph < 4 AND ((ins = 1 AND following < n) OR (ins = 0 AND len(live) > 0)))""",
        "log_ AS (SELECT i AS seq, i AS place, 1 AS op FROM (SELECT unnest(range(first)) AS i FROM n) UNION ALL SELECT seq - 1, place, op FROM walk WHERE op >= 0)",
    ]


def points(name: str) -> str:
    return POINTS[name]
