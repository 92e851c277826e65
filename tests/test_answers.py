import datetime as dt

import pytest
from pyspark.sql import functions as F

from ladoga import workspace
from ladoga.functions import text as T
from ladoga.operators import changes, chunking, fusion, grounding, lexical, rescoring, understanding, vector


def test_stored_index_ranks_like_the_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, "red red wine"), (4, None), (5, "")], "id long, text string")
    terms = spark.createDataFrame([(1, "apple"), (1, "red"), (2, "wine"), (3, "nothing")], "query_id long, term string")
    lexical.store_index(docs, str(tmp_path))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "id", "score", "matched").collect())
    assert rows(lexical.bm25_stored(spark, str(tmp_path), terms)) == rows(lexical.bm25(docs, terms)) != []
    assert lexical.bm25_stored(spark, str(tmp_path), terms.limit(0)).count() == 0


def test_once_keeps_one_row_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "k int, v string")
    assert sorted(r["v"] for r in workspace.once(df, "k").collect()) == ["a", "b", "c"]
    assert workspace.once(df.limit(0), "k").count() == 0


def test_broadcast_by_bytes(spark):
    wide = spark.createDataFrame([(1, ["x" * 1000] * 50)], "k int, v array<string>")
    assert workspace.bytes_of(wide) > 50_000 and workspace.bytes_of(wide.limit(0)) == 0
    plan = lambda most: spark.range(3).withColumnRenamed("id", "k").join(workspace.broadcast_within(wide, most), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(1 << 20) and "broadcast" not in plan(1000)


def test_no_local_checkpoint_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError):
        workspace.cut(type("D", (), {"sparkSession": Session()})())


def test_paragraphs_are_bounded(spark):
    long = " ".join(["слово"] * 400)
    df = spark.createDataFrame([(1, f"короткий\n\n{long}\n\nещё один абзац длиннее пятидесяти знаков, чтобы стоять отдельно"), (2, "x" * 2000), (3, None), (4, "")], "id long, text string")
    got = {}
    for r in chunking.paragraphs(df).collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert all(len(x) <= 800 for x in got[1] + got[2]) and set(got) == {1, 2}
    assert " ".join(got[1]).split() == f"короткий {long} ещё один абзац длиннее пятидесяти знаков, чтобы стоять отдельно".split()
    assert "".join(got[2]) == "x" * 2000


def test_records_and_lines_under_head(spark):
    df = spark.createDataFrame([(1, "head\n1. a\nb\n2. c"), (2, "only"), (3, None), (4, "")], "id long, text string")
    got = {(r["id"], r["line_no"]): r["record"] for r in chunking.records(df, "^[0-9]+\\.").collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): 2, (2, 0): 0, (4, 0): 0}
    parts = [(r["id"], r["chunk_index"], r["text"]) for r in chunking.lines_under_head(df, 2).orderBy("id", "chunk_index").collect()]
    assert parts == [(1, 0, "head\n1. a\nb"), (1, 1, "head\n2. c")]
    short = spark.createDataFrame([("один два три",), ("один",), (None,)], "t string").select(chunking.shortened(F.col("t"), 9)).collect()
    assert [r[0] for r in short] == ["один два…", "один", None]


def test_claims_and_their_support(spark):
    replies = spark.createDataFrame([(1, "Тел. +7 (203) 555-12-34, 29 500 рублей, 09.02.15"), (2, "Нет"), (3, None)], "id long, text string")
    evidence = spark.createDataFrame([(10, "звоните 8 203 555 12 34"), (11, "стоит 29 500 рублей"), (11, "стоит 29 500 рублей")], "id long, text string")
    stated = grounding.claims(replies).withColumn("form", grounding.claim_form())
    got = {(r["kind"], r["form"]) for r in stated.collect()}
    assert got == {("phone", "2035551234"), ("money", "29500"), ("code", "09.02.15")}
    there = {(r["kind"], r["form"]): r["fragments"] for r in grounding.stated_by(grounding.claims(evidence)).collect()}
    assert there == {("phone", "2035551234"): 1, ("money", "29500"): 1}


def test_contained_pieces_go(spark):
    rows = [(1, 1, 1, "a b"), (1, 2, 2, "x a b y"), (1, 3, 3, "x a b y"), (1, 4, 4, "z"), (2, 5, 1, "a b")]
    df = spark.createDataFrame(rows, "query_id long, id long, rank int, norm string")
    assert sorted(r["id"] for r in fusion.not_contained(df).collect()) == [2, 4, 5]


def test_clarifications(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(1, "s", "Сколько стоит?", True, t), (2, "s", "09.02.15", False, t + dt.timedelta(minutes=5)), (3, "s", "А приём?", None, t + dt.timedelta(minutes=9)), (4, "s", None, True, t + dt.timedelta(days=40)), (5, "s", "да", False, t + dt.timedelta(days=41))]
    df = spark.createDataFrame(rows, "turn_id long, session_id string, user_message string, is_ambiguous boolean, turn_ts timestamp")
    got = {r["turn_id"]: (r["answers"], r["question"], r["pending"]) for r in understanding.clarified(df).collect()}
    assert got[2] == (True, "Сколько стоит? 09.02.15", False) and got[3] == (False, "А приём?", False)
    assert got[1] == (False, "Сколько стоит?", True) and got[4] == (False, None, True) and got[5] == (False, "да", False)


def test_numbers_follow_the_hash(spark):
    rows = spark.createDataFrame([(f"u{i}",) for i in range(500)], "address string")
    got = changes.numbered(rows, F.sha2("address", 256), 7).select("id", F.sha2("address", 256).alias("h")).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(8, 508)) and [r["h"] for r in got] == sorted(r["h"] for r in got)
    assert changes.numbered(rows.limit(0), F.sha2("address", 256)).count() == 0


def test_addresses(spark):
    rows = [("#top", "https://A.example/x/y/"), ("/z", "https://a.example/x/y"), ("w.html", "https://a.example/x/y"), ("http://B.example/q#f", "https://a.example/"), ("", "https://a.example/p"), (None, "https://a.example/p")]
    df = spark.createDataFrame(rows, "href string, url string")
    got = [r[0] for r in df.select(T.absolute("href", "url")).collect()]
    assert got[:5] == ["https://A.example/x/y", "https://a.example/z", "https://a.example/x/w.html", "http://B.example/q", "https://a.example/p"]
    assert df.select(T.address("url")).head()[0] == "https://a.example/x/y"
    assert spark.range(1).select(T.unescaped(F.lit("&amp;lt; &quot;a&quot;"))).head()[0] == '&lt; "a"'


def test_vectors_as_blobs(spark):
    df = spark.createDataFrame([(1, [1.5, -2.0]), (2, []), (3, None), (4, [1.0, 2.0])], "id long, embedding array<float>")
    got = {r["id"]: (r["n"], r["back"]) for r in df.withColumn("b", vector.to_blob("embedding")).select("id", F.octet_length("b").alias("n"), vector.from_blob("b").alias("back")).collect()}
    assert got == {1: (8, [1.5, -2.0]), 2: (0, []), 3: (None, None), 4: (8, [1.0, 2.0])}
    assert {r["id"] for r in vector.of_common_dimension(df, df).collect()} == {1, 4}


def test_relevance_by_keywords(spark):
    df = spark.createDataFrame([("стоимость обучения колледж 09.02.15", "В колледже обучение по 09.02.15 имеет стоимость"), ("что", "x"), ("приём", None)], "question string, body string")
    got = [(r["hit"], r["relevance"]) for r in rescoring.by_keywords(df).collect()]
    assert got[0][0] >= 3 and got[0][1] > 1.5 and got[1] == (0, 0.0)
