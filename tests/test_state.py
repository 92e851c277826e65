import datetime as dt
import time

from pyspark.sql import functions as F

from ladoga.operators import changes, sessions, understanding
from ladoga.streaming import jobs

T0 = dt.datetime(2026, 1, 31, 23, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_merge_and_upsert(spark):
    a = spark.createDataFrame([("a", "1", 3), ("b", "1", 1), ("c", None, 1)], "url string, h string, version int")
    b = spark.createDataFrame([("a", "2", 0), ("b", "1", 0), ("d", "9", 0), ("c", None, 0)], "url string, h string, version int")
    got = {r["url"]: (r["status"], r["version"]) for r in changes.merge_by_hash(a, b, "url", "h").collect()}
    assert got == {"a": ("updated", 4), "b": ("unchanged", 1), "c": ("unchanged", 1), "d": ("new", 1)}
    assert {(r["url"], r["h"]) for r in changes.upsert(a, b, ["url"]).collect()} == {("a", "2"), ("b", "1"), ("c", None), ("d", "9")}
    assert changes.insert_missing(a, b, ["url"]).count() == 4


def test_dependencies(spark):
    recorded = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "x", 1), (3, "gone", 1)], "entry_id long, id string, version int")
    current = spark.createDataFrame([("x", 2), ("y", 1)], "id string, version int")
    got = {r["entry_id"]: (r["missing"], r["stale"], r["valid"]) for r in changes.dependency_state(recorded, current).collect()}
    assert got == {1: (0, 0, True), 2: (0, 1, False), 3: (1, 0, False)}


def test_sessions_over_midnight(spark):
    rows = [("hot", at(m)) for m in (0, 10, 55, 62, 70, 101, 5000)] + [("b", at(1)), (None, at(1)), ("b", None)]
    got = {(r["k"], r["started"], r["ended"], r["n"]) for r in sessions.idle_sessions(spark.createDataFrame(rows, "k string, t timestamp_ntz"), "k", "t").collect()}
    assert got == {("hot", at(0), at(10), 2), ("hot", at(55), at(70), 3), ("hot", at(101), at(101), 1), ("hot", at(5000), at(5000), 1), ("b", at(1), at(1), 1)}


def test_previous_turns_over_months(spark):
    rows = [(i, "s", at(i * 20_000), i) for i in range(8)] + [(100, "t", at(0), 100)]
    df = spark.createDataFrame(rows, "turn_id long, session_id string, ts timestamp_ntz, v long")
    got = {r["turn_id"]: r["previous"] for r in understanding.with_previous(df, "session_id", "ts", "turn_id", 3, F.col("v")).collect()}
    assert got == {i: list(range(max(0, i - 3), i)) for i in range(8)} | {100: []}


def test_intent(spark):
    df = spark.createDataFrame([(1, "Здравствуйте! Какие экзамены сдают на 54.02.12?"), (2, "А сколько стоит?"), (3, None)], "id long, text string")
    got = {r["id"]: r for r in understanding.intent(df).collect()}
    assert got[1]["topic"] == "exams" and got[1]["entities"] == {"code": "54.02.12"} and got[1]["greeting"]
    assert got[2]["topic"] == "payment" and got[2]["follow_up"] and got[3]["vague"] and got[3]["topic"] is None


def run(query):
    query.processAllAvailable()
    query.stop()


def test_dialog_sessions_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, turn_id long, turn_ts timestamp, topic string, user_message string"
    batches = [[("a", 1, at(0), "fees", "m1"), ("a", 2, at(10), None, "m2"), ("b", 3, at(5), None, None)], [("a", 4, at(90), "exams", "m3")], [("c", 5, at(400), None, "x")], [("c", 6, at(401), None, "y")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
        stream = jobs.dialog_sessions(spark.readStream.schema(schema).parquet(src))
        run(stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start(out))
    got = {(r["session_id"], r["turns"], r["topic"], tuple(r["last_messages"])) for r in spark.read.parquet(out).collect()}
    assert ("a", 2, "fees", ("m1", "m2")) in got and ("b", 1, None, ("",)) in got and ("a", 1, "exams", ("m3",)) in got


def test_pages_merge_stream(spark, tmp_path):
    store = str(tmp_path / "store")
    merge = jobs.merge_pages(store)
    schema = "id long, url string, content_hash string, fetched_at timestamp"
    merge(spark.createDataFrame([(1, "u", "1", at(0)), (2, "v", "1", at(0)), (3, "u", "2", at(1))], schema), 0)
    merge(spark.createDataFrame([(4, "u", "2", at(2)), (5, "v", "9", at(2)), (6, "w", "1", at(2))], schema), 1)
    merge(spark.createDataFrame([(4, "u", "2", at(2)), (5, "v", "9", at(2)), (6, "w", "1", at(2))], schema), 1)
    rows = spark.read.parquet(f"{store}/state").collect()
    assert {(r["batch"], r["url"], r["status"], r["version"]) for r in rows} == {(0, "u", "new", 1), (0, "v", "new", 1), (1, "u", "unchanged", 1), (1, "v", "updated", 2), (1, "w", "new", 1)}


def test_merge_with_snapshots(spark, tmp_path):
    store = str(tmp_path / "store")
    merge = jobs.merge_pages(store, compact=2)
    for n in range(5):
        merge(spark.createDataFrame([(n, "u", str(n // 2), at(n)), (n, f"x{n}", "1", at(n))], "id long, url string, content_hash string, fetched_at timestamp"), n)
    rows = {(r["batch"], r["url"]): (r["status"], r["version"]) for r in spark.read.parquet(f"{store}/state").collect()}
    assert [rows[n, "u"] for n in range(5)] == [("new", 1), ("unchanged", 1), ("updated", 2), ("unchanged", 2), ("updated", 3)]
    assert {r["url"] for r in spark.read.parquet(f"{store}/snapshots/4").collect()} == {"u", "x0", "x1", "x2", "x3"}


def test_metric_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame([(at(0), "a", 1.0), (at(10), "a", 2.0), (at(300), "b", 5.0)], schema).write.parquet(src)
    q = jobs.metric_stream(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("metrics").outputMode("append").start()
    run(q)
    assert [(r["event_type"], r["n"], r["total"]) for r in spark.sql("SELECT * FROM metrics").collect()] == [("a", 2, 3.0)]
