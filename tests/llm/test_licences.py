import re

from driftsum.llm import licences


def test_entire_texts(spark, hard, nothing):
    mit = dict(licences.entire_texts())["MIT"]
    body = next(t for i, t in licences.entire_texts() if i == "MIT")
    variants = [
        body, "MIT Licence\n\nCopyright (c) 2020 Jane Doe\nCopyright 2021 John\n\n" + body, re.sub(r"(.{60}\S*) ", r"\1\n", body), body.upper().replace('"', "“"), "/* " + body.replace("\n", "\n * ") + " */", mit + " And more.", body[:200], None, "",
        next(t for i, t in licences.entire_texts() if i == "ISC").replace("license", "licence"),
    ]
    docs = spark.createDataFrame([(i, t, "d", "l") for i, t in enumerate(variants)], "doc_id long, text string, digest string, licence string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(docs).collect()}
    assert [got[i] for i in range(len(variants))] == ["MIT", "MIT", "MIT", "MIT", "MIT", None, None, None, None, "ISC"]
    rows = licences.scan_licences(hard).collect()
    assert len(rows) == hard.count() and all(r["n_notices"] == 0 and r["licence"] is None and len(r["digest"]) == 64 for r in rows)
    assert licences.scan_licences(nothing).collect() == []


def test_notices(spark):
    text = "Intro\n  released UNDER the MIT Licence!\nLicensed under the Apache License, Version 2.0\nlicensed under nothing\nReleased under the MIT License."
    row = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_notices"], row["notices"], row["licence"]) == (3, "Apache-2.0,MIT", None)


def test_all_known_texts_differ(spark):
    names = {i for i, _ in licences.entire_texts()}
    rows = licences.known(spark, licences.entire_texts()).collect()
    assert len(rows) == 2 * len(names) and {r["licence"] for r in rows} == names


def test_long_texts(spark):
    """Whole licences, in other letters and line ends, with and without what follows the terms."""
    texts = {f.stem: f.read_text(encoding="utf-8") for f in licences.FILES.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    cases = [(i, v) for i, t in texts.items() for v in (t, t.upper().replace("\n", "\r\n"), t.partition(licences.END)[0])]
    docs = spark.createDataFrame([(n, t) for n, (_, t) in enumerate(cases)] + [(-1, texts["GPL-3.0"][:20_000])], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(docs).collect()}
    assert [got[n] for n in range(len(cases))] == [i for i, _ in cases] and got[-1] is None


def test_given_texts(spark, hard):
    more = spark.createDataFrame([("House-1.0", "Do as\nyou like."), ("House-0.9", "do as you LIKE"), ("Empty", ""), ("Null", None), (None, "Anything goes.")], "licence string, text string")
    docs = spark.createDataFrame([(1, "DO AS YOU LIKE!"), (2, ""), (3, None), (4, "Anything goes."), (5, licences.entire_texts()[0][1])], "doc_id long, text string")
    got = {r["doc_id"]: r["licence"] for r in licences.scan_licences(docs, more).collect()}
    assert got == {1: "House-0.9", 2: None, 3: None, 4: None, 5: "MIT"}
    assert licences.scan_licences(hard, more).count() == hard.count()
