import numpy as np
import pytest

from driftsum.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, vec string, weight int"


def brute(rows, cosine):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and any(v) for _, v in rows]
    x = [np.array(v, np.float32).astype(float) if k else None for (_, v), k in zip(rows, ok, strict=True)]
    n, label, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] / (np.linalg.norm(x[i]) * np.linalg.norm(x[j])) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(key, least.get(find(i), key))
    return sorted((rows[i][0], links[i], least[find(i)]) for i in range(n))


def make(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if a is None else float(a) for a in v], 1, 2, "v", 3) for k, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("unit", [8192, 16])
def test_against_all_pairs(spark, monkeypatch, unit):
    monkeypatch.setattr(vectors, "UNIT", unit)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        centre = rng.standard_normal(64)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((int(len(rows) * 31 % 997), centre + rng.standard_normal(64) * rng.choice([0, 0.05, 0.15, 0.22, 0.3])))
    rows += [(2000 + i, rng.standard_normal(5)) for i in range(20)] + [(3000 + i, [1.0, 2.0 + i / 100]) for i in range(10)] + [(4000 + i, [float(i - 2)]) for i in range(5)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 64), (5003, [float("nan")] * 64), (5004, [None, 1.0]), (5005, [float("inf")] + [1.0] * 63), (5006, rows[0][1]), (5007, rows[0][1] * 3)]
    rows = [(k, None if v is None else [None if a is None else float(np.float32(a)) for a in v]) for k, v in rows]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(make(spark, rows)).collect())
    assert got == brute(rows, 0.95)


def test_blocks_share_the_whole_budget():
    for dim in (1, 5, 16, 17, 64, 100):
        cuts = vectors.blocks(dim, 0.95)
        assert cuts[0][0] == 0 and cuts[-1][1] == dim and sum(b for _, _, b in cuts) == pytest.approx(0.1 + vectors.SLACK)
        r = vectors.rotation(dim)
        assert np.allclose(r @ r.T, np.eye(dim))


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(make(spark, rows)).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 0, 1), (2, 2, 1)]
    assert vectors.near_vectors(make(spark, rows).limit(0)).collect() == []
