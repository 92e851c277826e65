import random

from ladoga.llm.spans import merge_intervals, shared_intervals, shared_report, shared_spans


def brute(rows, length):
    seen = {}
    for i, t in rows:
        for a in range(len(t or "") - length + 1):
            seen.setdefault(t[a : a + length], set()).add(i)
    out = set()
    for i, t in dict(rows).items():
        flags = [False] * (len(t or "") + 1)
        for a in range(len(t or "") - length + 1):
            if len(seen[t[a : a + length]]) > 1:
                flags[a : a + length] = [True] * length
        start = None
        for p, f in enumerate(flags):
            if f and start is None:
                start = p
            elif not f and start is not None:
                out.add((i, start, p))
                start = None
    return out


def fixture(seed=1, copies=70):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("абвгд еёж\n") for _ in range(n))
    base = text(900)
    rows = [(0, base), (1, text(50) + base[100:420] + text(90)), (2, base[:199]), (3, None), (4, ""), (5, text(400) * 2), (6, base), (7, "😀" * 210), (8, "😀" * 500)]
    rows += [(100 + k, text(rng.randrange(60)) + base[300 - rng.randrange(80) : 520 + rng.randrange(80)] + text(70)) for k in range(copies)]
    return rows + [(1, rows[1][1])]


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string")
    return {tuple(r) for r in shared_spans(df, **kw).collect()}


def test_spans_equal_brute_force(spark):
    rows = fixture()
    assert found(spark, rows) == brute(rows, 200)


def test_few_ranges_a_signature(spark):
    rows = fixture(seed=2, copies=9)
    assert found(spark, rows) == brute(rows, 200)


def test_empty_and_report(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shared_spans(empty).count() == 0
    df = spark.createDataFrame([(1, "a b" * 100), (2, "a b" * 100), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["chars"], r["shared_chars"], r["share"]) for r in shared_report(df).collect()}
    assert got == {1: (300, 300, 1.0), 2: (300, 300, 1.0), 3: (0, 0, 0.0)}
    assert merge_intervals(shared_intervals(df)).count() == 2


def test_long_text_cut_in_pieces(spark, monkeypatch):
    import ladoga.llm.spans as spans

    monkeypatch.setattr(spans, "PIECE", 300)
    rows = fixture(seed=3, copies=2)
    import pandas as pd

    got = pd.concat(spans._anchors(200, 48)(iter([pd.DataFrame(rows, columns=["doc_id", "text"])])))
    text = dict(rows)
    assert all(len(text[i][s : s + n]) == n for i, s, n in zip(got.doc_id, got.start, got["size"]))
    assert got[got.doc_id == 0].start.max() + 200 <= 900
