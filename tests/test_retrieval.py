import math
import re
from collections import Counter

import numpy as np

from ladoga.operators import fusion, lexical, rescoring, vector

DOCS = [(i, t) for i, t in enumerate(["alpha beta beta gamma", "beta delta", "", None, "gamma gamma gamma gamma alpha", "alphabet soup alpha", "x " * 50 + "beta"])]


def brute(query):
    words = {i: re.findall(r"\w+", (t or "").lower()) for i, t in DOCS}
    mean = sum(len(w) for w in words.values()) / sum(t is not None for _, t in DOCS)
    n, out = len(DOCS), Counter()
    for term in set(query.split()):
        df = sum(term in w for w in words.values())
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 0) or 1e-6
        for i, w in words.items():
            if f := w.count(term):
                out[i] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean))
    return {i: round(s, 6) for i, s in out.items()}


def test_bm25(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    queries = spark.createDataFrame([(1, "beta gamma beta"), (2, "nothing"), (3, None), (4, "alpha")], "query_id long, text string")
    scored = lexical.bm25(docs, lexical.query_terms(queries))
    got = {}
    for r in scored.collect():
        got.setdefault(r["query_id"], {})[r["id"]] = r["score"]
    assert set(got) == {1, 4}
    for q, text in ((1, "beta gamma"), (4, "alpha")):
        want = brute(text)
        assert set(got[q]) == set(want) and all(abs(got[q][i] - want[i]) < 2e-6 for i in want)
    top = lexical.top_k(scored, 1).collect()
    assert {r["query_id"]: r["id"] for r in top} == {q: min(s, key=lambda i: (-s[i], i)) for q, s in got.items()}
    prefixes = spark.createDataFrame([(1, "alpha")], "query_id long, prefix string")
    assert {r["id"] for r in lexical.bm25_prefix(docs, prefixes).collect()} == {0, 4, 5}
    phrases = spark.createDataFrame([(1, "beta", "beta")], "query_id long, first string, second string")
    assert [(r["id"], r["n"]) for r in lexical.phrase_counts(docs, phrases).collect()] == [(0, 1)]
    assert lexical.bm25(docs.limit(0), lexical.query_terms(queries)).count() == 0


def test_cosine_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "ROWS", 40)
    monkeypatch.setattr(vector, "QUERIES", 5)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(130, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(500, None)], "id long, vector array<double>")
    queries = df.where("id % 10 = 0").selectExpr("id AS query_id", "vector")
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    got = {}
    for r in vector.cosine_top_k(df, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(0, 130, 10):
        s = np.round(unit @ unit[q], 6)
        assert got[q] == sorted((i for i in range(130) if i != q), key=lambda i: (-s[i], i))[:4]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1, 2.0), (1, 11, 2, 1.0)], "query_id long, id long, rank int, score double")
    b = spark.createDataFrame([(1, 11, 1, 4.0), (1, 12, 2, 3.0)], "query_id long, id long, rank int, score double")
    rrf = {r["id"]: r["score"] for r in fusion.reciprocal_ranks(a, b).collect()}
    assert rrf == {10: round(1 / 61, 9), 11: round(1 / 61 + 1 / 62, 9), 12: round(1 / 62, 9)}
    assert {r["id"]: r["score"] for r in fusion.weighted(a, b).collect()} == {10: 2.0, 11: 2.8, 12: 1.8}


def test_evidence_and_packing(spark):
    rows = [(1, i, i, 0.5 if i in (6, 8, 9) else 0.1, "t" * 1000, 0.03) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "query_id long, id long, rank int, coverage double, text string, score double")
    assert sorted(r["id"] for r in fusion.evidence(df).collect()) == [1, 2, 3, 4, 6, 8]
    assert sorted(r["id"] for r in fusion.pack(df).collect()) == [1, 2, 3, 4]
    assert sorted(r["id"] for r in fusion.pack(df, budget=10).collect()) == [1]
    assert fusion.sufficiency(df).first()["sufficient"] is False
    twice = spark.createDataFrame([(1, 5, 1, "u", "same"), (1, 3, 2, "u", "same"), (1, 4, 3, "v", "same")], "query_id long, id long, rank int, url string, text string")
    assert sorted(r["id"] for r in fusion.first_by_prefix(twice, ["url"]).collect()) == [4, 5]


def test_rescoring(spark):
    row = (1, 7, 0.5, "экзамены 54.02.01", "Экзамены", "54.02.01", "https://a.example/teachers/x/", "exams", "exams")
    df = spark.createDataFrame([row, (1, 8, 0.5, "экзамены", None, None, "https://a.example/", None, None)], "query_id long, id long, score double, question string, section_title string, specialty_code string, url string, topic string, text_topic string")
    got = {r["id"]: r for r in rescoring.rescored(df).collect()}
    assert got[7]["code"] == 0.4 and got[7]["context"] == 0.15 and got[7]["factor"] == 2.0
    assert got[7]["score"] == round((0.5 + 0.4 + got[7]["section"] + 0.15) * 2, 6) and got[8]["score"] == 0.075
