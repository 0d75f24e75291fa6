import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftsum.llm import components, minhash
from driftsum.llm.text import shingle_hashes, word_hashes


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent):
    """component and set size by position of the row, from all pairs."""
    sets = [shingle_set(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and ((a and b and 100 * len(a & b) >= percent * len(a | b)) or rows[i][0] == rows[j][0] and a == b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(s), least.get(find(i)) if doc is not None else None) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))]


def found(df):
    return sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()], key=repr)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_hard_texts(hard, size, percent):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    out = minhash.near_duplicates(hard, size, percent)
    assert found(out) == sorted(brute(rows, size, percent), key=repr)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in out.collect())


def test_empty_table(nothing):
    assert minhash.near_duplicates(nothing).collect() == []


def test_random_families_with_small_units(spark, monkeypatch):
    """Chains and families of edited texts, with units so small that buckets and clusters are cut."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "CLUSTER", 3)
    r = random.Random(5)
    rows = []
    for family in range(12):
        text = [f"w{r.randrange(40)}" for _ in range(r.choice([4, 12, 60, 200]))]
        for _ in range(r.randint(2, 14)):
            rows.append((len(rows) * 7 % 1000, " ".join(text)))
            for _ in range(r.randint(0, 1 + len(text) // 40)):
                text[r.randrange(len(text))] = f"e{family}_{r.randrange(999)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(minhash.near_duplicates(docs, 3, 85)) == sorted(brute(rows, 3, 85), key=repr)


def test_units_hold_a_bounded_number_of_bytes(spark, monkeypatch):
    """Long texts in one cluster: the held part of a unit is cut by the bytes of its sets, and links are not lost."""
    monkeypatch.setattr(minhash, "SET_BYTES", 8 * 3000)
    r = random.Random(6)
    base = [f"w{i}" for i in range(1500)]
    rows = []
    for i in range(24):  # a chain: neighbours are alike, the ends are not
        rows.append((100 - i, " ".join(base)))
        for j in range(20):
            base[(i * 60 + j * 3) % 1500] = f"e{r.randrange(10**9)}"
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(minhash.near_duplicates(docs, 3, 85)) == sorted(brute(rows, 3, 85), key=repr)
    members = spark.createDataFrame([(i, 1500, 1, i) for i in range(24)], "node long, n long, cluster long, label long")
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    held = [u["n"] for u in minhash._units(members, texts).where("role = 0").select("i", "node").distinct().groupBy("i").agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 23 and len(held) >= 6 and max(held) <= 8


def test_stage_keeps_one_of_each_group(spark, hard):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    keep = {c for doc, _, c in brute(rows, 5, 80) if doc is not None}
    out = minhash.stage_near_duplicates(spark, hard, "")
    assert out.columns == hard.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(keep) and ids.count(None) == 2


def test_registers_and_estimates():
    rng = np.random.default_rng(1)
    for shared in (0.2, 0.5, 0.9):
        errors = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
            n = int(2000 * shared)
            a, b = np.unique(x[:2000]), np.unique(np.concatenate([x[:n], x[2000 : 4000 - n]]))
            j, used = minhash.estimate(minhash.registers(a), minhash.registers(b), np.array(len(a)), np.array(len(b)))
            errors.append(j - n / (4000 - n))
            assert used == 128
        assert abs(np.mean(errors)) < 0.03
    exact = np.array([0, 1, (1 << 57) - 1, (1 << 57) | 3], np.uint64)
    got = minhash.registers(exact)
    assert got[0] == (57 << 10) + 1 and got[1] == ((57 - 2) << 10 | (1 << 9)) + 1


def test_shingles_of_short_texts():
    h = word_hashes([b"a", b"b"])
    assert len(shingle_hashes(h, 3)) == 1 and len(shingle_hashes(h[:0], 3)) == 0
    assert len(shingle_hashes(word_hashes([b"a"] * 50), 3)) == 1


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(5, x) for x in range(6, 300)] + [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(150)] + [(1, 1), (None, 4), (5, 6), (6, 5)]
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    got = {row["node"]: row["root"] for row in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in label}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
