import hashlib
import random

import numpy as np

from driftsum.llm import substring


def brute(rows, window):
    first = {}
    for doc, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - window + 1):
            if doc is not None:
                k = tuple(w[i : i + window])
                first[k] = min(doc, first.get(k, doc))
    out = []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=repr)


def found(df):
    return sorted([tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept")) for r in df.collect()], key=repr)


def test_difference_cover():
    differences = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert differences == set(range(substring.PERIOD))


def test_hard_texts(hard):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert found(substring.remove_repeats(hard)) == brute(rows, 50)
    assert found(substring.remove_repeats(hard, part_bytes=20_000)) == brute(rows, 50)


def test_empty_table(nothing):
    assert substring.remove_repeats(nothing).collect() == []


def test_random_passages_at_all_offsets(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(30)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 64, 80, 81, 130)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(r.randint(0, 4)):
            text += [f"u{i}_{r.randrange(10**6)}" for _ in range(r.randint(0, 70))]
            p = r.choice(passages)
            cut = r.choice([0, 0, 1, 7])
            text += p[cut:]
        rows.append((r.randrange(10**6) if i % 9 else i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(substring.remove_repeats(docs, part_bytes=5000)) == brute(rows, 50)
    assert found(substring.remove_repeats(docs, window=40, part_bytes=5000)) == brute(rows, 40)


def test_query(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    rows = duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op10_substring(spark, sf).collect())
    assert got == sorted((d, n, x, hashlib.sha256(k.encode()).hexdigest()) for d, n, x, k in brute(rows, 50))


def test_find_among_equal_lower_halves():
    pair = substring._PAIR
    every = np.array([(1, 1), (1, 5), (1, 9), (2, 0)], pair)
    at, there = substring._find(every, np.array([(1, 5), (1, 6), (2, 0), (3, 0), (1, 1)], pair))
    assert there.tolist() == [True, False, True, False, True] and at[0] == 1 and at[2] == 3


def test_empty_rows_are_dealt_out(spark):
    """They stay in the partitions of the input: no exchange gathers them."""
    docs = spark.range(200_000, numPartitions=8).selectExpr("id AS doc_id", "'' AS text").unionAll(spark.createDataFrame([(-1, "a b c")], "doc_id long, text string"))
    from pyspark.sql import functions as F

    rows = substring.remove_repeats(docs).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("n_words").alias("w")).collect()
    assert sum(r["n"] for r in rows) == 200_001 and max(r["n"] for r in rows) <= 50_000 and sum(r["w"] for r in rows) == 3


def test_equal_rows_and_one_id_with_many_texts(spark):
    r = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(5, passage + " tail")] * 40 + [(5, f"h{i} " + passage) for i in range(30)] + [(3, f"{passage} three")] + [(7, passage)] * 6 + [(None, passage)] * 3 + [(9, " ".join(f"q{r.randrange(9)}" for _ in range(80)))] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(substring.remove_repeats(docs, part_bytes=2000)) == brute(rows, 50)
