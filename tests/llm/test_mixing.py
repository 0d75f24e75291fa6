from pyspark.sql import functions as F

from driftsum.llm import mixing
from driftsum.session import table

SF = "/root/testdata/sf0.01"


def filled(sizes, weights, total, limit):
    """Targets by handing out what exceeds the limits, round by round."""
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while True:
        left = total - sum(target[s] for s in sizes if s not in open_)
        w = sum(weights[s] for s in open_)
        for s in open_:
            target[s] = left * weights[s] / w
        full = {s for s in open_ if target[s] > limit * sizes[s]}
        if not full:
            return target
        for s in full:
            target[s] = limit * sizes[s]
        open_ -= full


def test_rates(spark):
    for sizes in ([10, 1000, 3, 500, 0, 70], [5], [1, 1, 1, 1], [0, 9], [1000, 1, 1, 1, 1, 1, 1]):
        names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
        rows = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
        got = {r["source"]: r for r in mixing.source_rates(rows).collect()}
        want = filled(dict(zip(names, sizes, strict=True)), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes), 2)
        for s, n in zip(names, sizes, strict=True):
            assert abs(got[s]["target"] - want[s]) < 1e-6 and got[s]["source_size"] == n and 0 <= got[s]["rate"] <= 2


def test_taken_words_come_near_their_targets(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 50).cast("int")).alias("text"))
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    out = mixing.with_copies(sized, mixing.source_rates(sized))
    rows = out.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.05 and r["most"] <= 2 for r in rows)


def test_reruns_agree_however_rows_are_dealt(spark):
    docs = table(spark, SF, "documents")
    key = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    assert key(mixing.mix_documents(docs)) == key(mixing.mix_documents(docs.repartition(7)))


def test_hard_texts(spark, hard, nothing):
    out = mixing.mix_documents(hard)
    assert out.columns == hard.columns
    mixed = {repr(r) for r in out.collect()}
    assert mixed <= {repr(r) for r in hard.collect()}
    sized = hard.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = mixing.with_copies(sized, mixing.source_rates(sized)).collect()
    assert len(rows) == hard.count() and {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mix_documents(nothing).collect() == []
