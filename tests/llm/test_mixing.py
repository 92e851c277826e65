import random

import pandas as pd

from ladoga.llm import mixing

SOURCES = {"a": 400, "b": 60, "c": 8, "hot": 900}


def frames(spark):
    rng = random.Random(7)
    rows, i = [], 0
    for s, n in SOURCES.items():
        for _ in range(n):
            rows.append((i, s, rng.choice(["ru", "en", None]), rng.choice(["news", None]), "слово word " * rng.randrange(1, 40)))
            i += 1
    rows += [(i, None, "ru", "news", "text"), (i + 1, "a", "ru", "news", None), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, text string")
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, 4), ("gap", "hot", 0.6, 1), ("gap", "none", 0.4, 3)]
    return docs, spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int"), targets


def test_shares_and_caps(spark):
    docs, targets, given = frames(spark)
    chosen = mixing.choose(docs, targets)
    caps = {(m, s): c for m, s, _, c in given}
    rows = chosen.collect()
    assert len({(r["mix_name"], r["doc_id"]) for r in rows}) == len(rows)
    assert all(1 <= r["repeats"] <= caps[r["mix_name"], r["source"]] for r in rows)
    got = {(r["mix_name"], r["source"]): r for r in mixing.shares(chosen, targets).collect()}
    for m, s, share, _ in given[:3]:
        assert abs(got[m, s]["actual_share"] - share) < 0.02
    assert got["gap", "none"]["tokens"] == 0 and got["gap", "hot"]["actual_share"] == 1.0
    # the small source is used up: the total can't be larger
    assert got["m", "c"]["most_repeats"] == 4
    assert sorted(chosen.collect()) == sorted(rows)


def test_raking_keeps_margins():
    cells = pd.DataFrame([(s, lang, "t", n, 5) for s, lang, n in [("a", "x", 100), ("a", "y", 300), ("b", "x", 50), ("b", "y", 10)]], columns=["source", "lang", "topic", "tokens", "cap"])
    cells["w"] = mixing.rake(cells, {"a": 0.5, "b": 0.5})
    by = cells.groupby("source")["w"].sum()
    assert abs(by["a"] - by["b"]) < 1e-6 * by["a"] and (cells.w <= 5 * cells.tokens + 1e-6).all() and abs(by.sum() - 600) < 1e-3


def test_empty(spark):
    docs, targets, _ = frames(spark)
    assert mixing.choose(docs.limit(0), targets).count() == 0
    assert mixing.shares(mixing.choose(docs, targets.limit(0)), targets).where("tokens > 0").count() == 0
