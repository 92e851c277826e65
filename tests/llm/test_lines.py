import itertools
import random
import re

from ladoga.llm.lines import _clusters, _hashed, _links, repeated_lines, repeated_positions, without_repeated


def norm(line):
    return re.sub("[0-9]+", "0", re.sub("[ \t ]+", " ", line).strip(" ").lower())


def brute(pages, fragments):
    texts, source = {}, {}
    for i, s, t in pages:
        texts[i], source[i] = t or "", s
    out = set()
    rows = [("pages", i, i, t) for i, t in texts.items()] + [("fragments", i, p, t or "") for i, p, t in set(fragments) if p in source]
    for tbl, rec, page, t in rows:
        same = [i for i in texts if source[i] == source[page]]
        if source[page] is None:
            continue
        for n, line in enumerate(t.split("\n")):
            hits = sum(norm(line) in {norm(x) for x in texts[i].split("\n")} for i in same)
            if norm(line) and hits >= 3 and hits >= 0.2 * len(same):
                out.add((tbl, rec, n))
    return out


PAGES = (
    [(i, 1, f"Menu\n \nText number {i} of this  site\nbody {'x' * i}\n  Views: {i * 37}  \nFOOTER") for i in range(12)]
    + [(3, 1, "Menu\n \nText number 3 of this  site\nbody xxx\n  Views: 111  \nFOOTER")]
    + [(100 + i, 2, None if i == 0 else "" if i == 1 else f"menu\nother {chr(97 + i)}") for i in range(20)]
    + [(200, None, "menu"), (201, 3, "menu"), (202, 3, "menu")]
)
FRAGMENTS = [(1, 2, "Text number 9 of this site\nbody y"), (1, 2, "Text number 9 of this site\nbody y"), (2, 999, "menu"), (3, None, "menu"), (4, 100, None), (5, 101, "footer\nMENU")]


def frames(spark, clash=True):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "id long, source_id long, clean_text string, line string")
    return pages, spark.createDataFrame([(*f, 1) for f in FRAGMENTS], "id long, page_id long, text string, n int")


def test_positions_equal_brute_force(spark):
    pages, fragments = frames(spark)
    assert {tuple(r) for r in repeated_positions(pages, fragments).collect()} == brute(PAGES, FRAGMENTS)


def test_texts_lose_exactly_those_lines(spark):
    pages, fragments = frames(spark)
    got = {(r["tbl"], r["rec_id"]): r for r in without_repeated(pages, fragments).collect()}
    assert got["fragments", 5]["text"] == "footer" and got["pages", 0]["text"] == " \nbody "
    assert got["pages", 100]["text"] is None and got["pages", 101]["text"] == ""
    assert got["pages", 201]["removed"] == 0


SHARE = "please share this page with all of your very good friends at school and also with {}"


def test_near_duplicate_clusters(spark):
    words = ["colleagues"] * 2 + ["pupils"] * 2 + ["mum"]
    rows = [(i, 1, SHARE.format(w) + f"\nbody {chr(97 + i) * 9}") for i, w in enumerate(words)]
    pages = spark.createDataFrame(rows, "id long, source_id long, clean_text string")
    near = {r["line"]: (r["cluster"], r["pages"]) for r in repeated_lines(pages, exact=False).collect()}
    assert set(near) == {SHARE.format(w) for w in words} and set(near.values()) == {(SHARE.format("pupils"), 5)}
    assert repeated_lines(pages).count() == 0  # none stands on three pages by itself
    fragments = spark.createDataFrame([(1, 0, SHARE.format("mum"))], "id long, page_id long, text string")
    got = {(r["tbl"], r["rec_id"]): r["text"] for r in without_repeated(pages, fragments).collect()}
    assert got["fragments", 1] == "" and got["pages", 4] == "body " + "e" * 9
    assert repeated_positions(pages, fragments).count() == 0


def shingles(line):
    w = line.split(" ")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_links_of_planted_variants_against_brute_force(spark):
    """Recall of pairs in one cluster, chains of near duplicates included."""
    rnd = random.Random(11)
    lines = []
    for _ in range(40):
        line = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(12, 40))]
        lines.append(" ".join(line))
        for _ in range(rnd.randrange(6)):
            line = list(line)
            line[rnd.choice([0, -1])] = f"v{rnd.randrange(5000)}"
            lines.append(" ".join(line))
    masked = spark.createDataFrame([(1, x, 1, 1000) for x in lines], "source_id long, masked string, pages long, n long")
    hashed = _hashed(masked).cache()
    name = {r["id"]: r["masked"] for r in hashed.collect()}
    links = _links(hashed)
    pairs = {frozenset((name[r["a"]], name[r["b"]])) for r in links.collect()}
    alike = lambda a, b: len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
    assert all(alike(*p) for p in pairs)
    cluster = {name[r["id"]]: r["cluster"] for r in _clusters(links).collect()}
    truth = [(a, b) for a, b in itertools.combinations(sorted(set(lines)), 2) if alike(a, b)]
    found = sum(a in cluster and cluster[a] == cluster.get(b) for a, b in truth)
    assert len(truth) > 60 and found >= 0.95 * len(truth)


def test_empty(spark):
    pages, fragments = frames(spark)
    assert repeated_positions(pages.limit(0), fragments.limit(0)).count() == 0
