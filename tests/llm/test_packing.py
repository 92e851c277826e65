import random
from collections import Counter

import pytest

from ladoga.llm import packing


@pytest.mark.parametrize("capacity", [1, 2, 7, 64])
def test_plan_holds_every_item_once(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 5, 400):
        counts = Counter(rng.randint(1, capacity) for _ in range(n))
        got, bins = Counter(), 0
        for items, m in packing.plan(dict(counts), capacity):
            assert 0 < sum(items) <= capacity and m > 0
            bins += m
            for x in items:
                got[x] += m
        total = sum(k * v for k, v in counts.items())
        assert got == counts and -(-total // capacity) <= bins <= 11 * (total // capacity + 1) // 9 + 1


def test_exact_complements_are_found():
    for counts in ({5: 3, 95: 3}, {20: 2, 30: 2, 50: 2}, {10: 1, 20: 1, 30: 1, 40: 1}):
        assert sum(m for _, m in packing.plan(counts, 100)) == sum(k * v for k, v in counts.items()) // 100


def test_pack(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("слово word 42 !".split()[rng.randrange(4)] for _ in range(rng.randrange(1, 60))), "x") for i in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "long text " * 500, "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    specs = spark.createDataFrame([("a", 64), ("b", 500)], "spec_name string, capacity_tokens int")
    sizes = {r["doc_id"]: r["tokens"] for r in packing.token_counts(docs.select("doc_id", "text"), ["doc_id"]).collect()}
    for spec, capacity in (("a", 64), ("b", 500)):
        got = packing.pack(docs, specs).where(f"spec_name = '{spec}'").collect()
        load, parts = Counter(), {}
        for r in got:
            load[r["container_id"]] += r["tokens"]
            parts.setdefault(r["doc_id"], []).append((r["part"], r["start_token"], r["tokens"]))
        assert max(load.values()) <= capacity and set(parts) == set(sizes)
        for i, ps in parts.items():
            ps.sort()
            assert sum(n for *_, n in ps) == sizes[i] and len(ps) == max(1, -(-sizes[i] // capacity))
            assert all(n == capacity for *_, n in ps[:-1]) and [s for _, s, _ in ps] == [k * capacity for k in range(len(ps))]
        assert set(load) <= set(range(len(load)))
    got = {r["spec_name"]: r for r in packing.report(packing.pack(docs, specs), specs).collect()}
    assert got["a"]["overfull"] == 0 and got["a"]["used"] > 0.97 and got["a"]["split_documents"] == sum(n > 64 for n in sizes.values())


def test_empty(spark):
    specs = spark.createDataFrame([("a", 64)], "spec_name string, capacity_tokens int")
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), specs).count() == 0
