import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftsum.llm import toxicity
from driftsum.session import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark, model):
    docs = table(spark, SF, "documents")
    rows = toxicity.score_documents(docs, model).join(table(spark, SF, "labels"), "doc_id").where(toxicity.held_out()).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    said = [(r["score"] >= 0.7, r["toxic"] == 1) for r in rows]
    hit, wrong = sum(a and b for a, b in said), sum(a and not b for a, b in said)
    assert hit / (hit + wrong) >= 0.9 and hit / sum(b for _, b in said) >= 0.9


def plain_ftrl(rows):
    """FTRL-proximal, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(zi) <= l1 and l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for label, at in rows:
            here = [*at.tolist(), "bias"]
            w = {i: weight(i) for i in here}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - label
            if abs(g) < 1e-4:
                continue
            for i in here:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if weight(i) != 0}


def labelled_rows(n):
    import duckdb

    rows = duckdb.connect().execute(f"SELECT text, max(toxic) FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id) GROUP BY doc_id, text ORDER BY max(toxic) DESC, doc_id").fetchall()
    rows = rows[: n // 2] + rows[-(n // 2) :]
    return [(y, toxicity.features(t)) for pair in zip(rows[: n // 2], rows[n // 2 :], strict=True) for t, y in pair]


def test_weights_of_plain_ftrl():
    rows = labelled_rows(200)
    model, plain = toxicity._fit(rows, 0.5), plain_ftrl(rows)
    bias = plain.pop("bias")
    assert len(plain) > 5 and model.index.tolist() == sorted(plain)
    assert model.weight == pytest.approx([plain[i] for i in sorted(plain)]) and model.bias == pytest.approx(bias)


def test_cut_is_the_best_of_all():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 12)
        x, y, w = np.array([r.randint(0, 6) for _ in range(n)], float), np.array([r.randint(0, 1) for _ in range(n)]), np.array([r.choice([0.5, 1.0, 3.0]) for _ in range(n)])
        f1 = lambda cut: 2 * (w * y)[x >= cut].sum() / (w[x >= cut].sum() + (w * y).sum())  # noqa: E731, B023
        cut = toxicity.best_cut(x, y, w)
        if y.all() or not y.any():
            assert cut is None
        else:
            assert f1(cut) == pytest.approx(max(f1(c) for c in {*x})) and cut not in x


def test_features_are_cut_before_they_are_sent(spark, monkeypatch):
    """A bound that some rows fit into: the model is that of the first rows, whatever comes after them."""
    docs = spark.createDataFrame([(i, f"w{i} " * 3 + ("bad " if i % 2 else "good ") + " ".join(f"x{j}" for j in range(i % 7))) for i in range(60)] + [(3, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    whole = toxicity.train(docs, labels)
    rows = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1)
    texts = {r["doc_id"]: r["text"] for r in docs.where("text <> 'another text'").collect()}
    sizes = [len(toxicity.features(texts[i])) for _, i in rows]
    monkeypatch.setattr(toxicity, "FEATURES", sum(sizes[:20]))
    few = toxicity.train(docs, labels)
    kept = [i for _, i in rows[:20]]
    assert 3 not in kept and few.bias != whole.bias
    share = (sum(i % 2 for _, i in rows) + 0.5) / (len(rows) + 1)
    expected = toxicity.fit_rows([(i % 2, toxicity.features(texts[i])) for i in kept], share)
    assert few.bias == expected.bias and (few.weight == expected.weight).all()


def test_model_is_sparse_and_ignores_held_out_labels(spark, model):
    assert 0 < len(model.index) < 5000
    labels = table(spark, SF, "labels")
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(table(spark, SF, "documents"), changed)
    assert other.bias == model.bias and (other.weight == model.weight).all()


def test_hard_texts(spark, hard, model):
    rows = toxicity.score_documents(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    assert toxicity.drop_toxic(hard, model).columns == hard.columns
    assert toxicity.drop_toxic(hard, model, 1.1).count() == hard.count()
    assert toxicity.drop_toxic(hard, model, 0.0).count() == 0


def test_no_labels_and_no_rows(spark, hard, nothing):
    none = table(spark, SF, "labels").limit(0)
    model = toxicity.train(hard, none)
    assert {r["score"] for r in toxicity.score_documents(hard, model).collect()} == {0.5}
    assert toxicity.score_documents(nothing, model).collect() == []
    odd = spark.createDataFrame([(4, 1), (4, 0), (7, None), (None, 1), (12345, 1), (8, 0)], "doc_id long, toxic int")
    assert toxicity.score_documents(hard, toxicity.train(hard, odd)).count() == hard.count()
