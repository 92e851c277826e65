"""The best texts of each question, against the rankings of all pairs, and that those pairs are not written."""

import datetime
import random

import pytest

import __spark_entry__
from ladoga.operators import lexical


def ranked(df):
    return sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())


def texts_and_queries(spark):
    rng = random.Random(3)
    docs = [(i * 7 % 401, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "common"]) + rng.choice(["", "", "x"]) for _ in range(rng.randint(0, 12)))) for i in range(401)]
    docs += [(500 + i, "alpha alpha common") for i in range(30)] + [(600, None)]
    queries = [(1, "alpha beta"), (2, "beta alpha"), (3, "common"), (4, "gammax"), (5, "nothing"), (6, None), (7, "delta omega common alphax"), (8, "alpha nothing")]
    return spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize("rows,queries", [(20_000, 10_000), (37, 3)])
def test_the_best_of_blocks_are_the_best_of_all(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(lexical, "ROWS", rows)
    monkeypatch.setattr(lexical, "QUERIES", queries)
    docs, asked = texts_and_queries(spark)
    terms = lexical.query_terms(asked)
    for k in (1, 10):
        got = lexical.both_top_k(docs, terms, k)
        want = lexical.top_k(lexical.bm25(docs, terms), k), lexical.top_k(lexical.tf_saturation(docs, terms), k)
        assert [ranked(x) for x in got] == [ranked(x) for x in want]
    prefixes = terms.selectExpr("query_id", "substring(term, 1, 4) AS prefix").distinct()
    assert ranked(lexical.prefix_top_k(docs, prefixes, 10)) == ranked(lexical.top_k(lexical.bm25_prefix(docs, prefixes), 10))
    assert lexical.prefix_top_k(docs, prefixes.limit(0), 10).count() == 0
    empty = lexical.both_top_k(docs.limit(0), terms, 10) + lexical.both_top_k(docs, terms.limit(0), 10)
    assert [x.count() for x in empty] == [0, 0, 0, 0]


def shuffled_rows(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


#: Queries that rank all texts for many questions.
OF_BLOCKS = ["fuse_rrf", "bm25_prefix", "hybrid_pipeline", "eval_report", "pack_budget", "sufficiency", "contained_evidence", "evidence_select", "fuse_rrf0", "dedup_url_prefix", "extractive_answer", "fuse_weighted", "threshold_filter"]


@pytest.mark.parametrize("name", OF_BLOCKS)
def test_pairs_of_questions_and_texts_are_not_written(spark, tmp_path, name):
    n, m = 300, 300
    day = datetime.datetime(2025, 1, 1)
    frags = [(i, f"common{' common' * (i % 3)} words text{i}", f"https://a.example/{i}", i, day) for i in range(n)]
    asked = [(100 * i, f"common words text{i} other{i}", "s") for i in range(m)]
    spark.createDataFrame(frags, "id long, text string, url_stable string, page_id long, created_at timestamp").write.parquet(f"{tmp_path}/fragments.parquet")
    spark.createDataFrame(asked, "request_id long, question string, session_id string").write.parquet(f"{tmp_path}/chat_requests.parquet")
    before = shuffled_rows(spark)
    assert __spark_entry__.queries()[name](spark, str(tmp_path)).count()
    assert shuffled_rows(spark) - before < n * m
