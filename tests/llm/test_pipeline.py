import hashlib
import math

import corpus_pipeline
import duckdb
import pytest
import test_near_duplicates
import test_secrets
from tokenizers import Tokenizer

from driftsum.llm import bpe, registry, secrets, toxicity
from driftsum.session import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns and docs.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_run_gives_what_the_stages_give(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)


def plain_pipeline(spark):
    """The rows of run() by plain versions of each stage."""
    model = toxicity.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    weights = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "source").collect()]
    logit = lambda t: model.bias + sum(weights.get(i, 0.0) for i in toxicity.features(t).tolist())
    docs = [d for d in docs if 1 / (1 + math.exp(-max(-30, min(30, logit(d[1]))))) < toxicity.THRESHOLD]
    keep = {c for _, _, c in test_near_duplicates.brute([d[:2] for d in docs], 5, 80)}
    docs = [d for d in docs if d[0] in keep]
    ratios = secrets.train(secrets.labelled_samples(spark))
    docs = [(i, test_secrets.cleaned(t, ratios), s) for i, t, s in docs]
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:  # sources that are full give the rest to the others
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left, free = left - sum(2 * sizes[s] for s in full), free - full
    library, out = Tokenizer.from_file(bpe.default_vocabulary()), []
    for i, t, s in docs:
        rate = min(2.0, target[s] / sizes[s]) if sizes[s] else 0.0
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        ids = library.encode(t or "", add_special_tokens=False).ids
        out += [(i, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), hashlib.sha256((t or "").encode()).hexdigest())] * (int(rate) + (u < rate - int(rate)))
    return sorted(out)


def test_run_against_plain_versions(spark):
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect())
    expected = plain_pipeline(spark)
    assert got == expected and 0 < len(got)


def test_hard_texts_pass_all_stages(spark, hard, nothing):
    docs = hard
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == hard.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = c.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    other = sorted(repr([number(r[names.index(k)]) for k in columns]) for r in result.fetchall())
    assert sorted(repr([number(r[k]) for k in columns]) for r in df.collect()) == other
