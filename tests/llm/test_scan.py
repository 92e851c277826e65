from ladoga.llm import scan

WORDS = "колледж объявляет приём документов на новый учебный год расписание занятий публикует учебный отдел каждый понедельник".split()


def docs(spark):
    body = " ".join(WORDS) + "."
    scan_text = "\n".join(
        ["Отдел кадров", "колледж объявляет при-", "ём документов на н0вый", "учебиый год расписание", "стр. 1", "Отдел кадров", "занятий публикует учебно-", "методический отдел каждый", "понедельиик", "", "2019", "", "новый год", "— 2 —"]
    )
    right = scan_text.replace("н0вый", "новый").replace("учебиый", "учебный").replace("понедельиик", "понедельник")
    rows = [(i, body + " учебно-методический отдел", None if i % 2 else scan_text if i == 2 else right) for i in range(8)]
    rows += [(50, None, ""), (51, "", None), (52, None, "I\n\nновый год"), rows[0]]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, extracted_text string, line int")


def test_kinds_of_lines(spark):
    got = {(r["line_no"], r["kind"]) for r in scan.found_noise(docs(spark)).where("doc_id = 2").collect()}
    assert got == {(0, "header"), (5, "header"), (4, "page_number"), (13, "page_number"), (1, "hyphen"), (2, "misread"), (3, "misread"), (8, "misread")}
    assert {(r["line_no"], r["kind"]) for r in scan.found_noise(docs(spark)).where("doc_id = 52").collect()} == {(0, "page_number")}


def test_repaired(spark):
    got = {r["doc_id"]: r["repaired"] for r in scan.repaired_texts(docs(spark)).collect()}
    assert got[2].split("\n\n")[0] == "колледж объявляет приём документов на новый учебный год расписание занятий публикует учебно-методический отдел каждый понедельник"
    assert got[50] == "" and set(got) == {0, 2, 4, 6, 50, 52}


def test_empty(spark):
    assert scan.found_noise(docs(spark).limit(0)).count() == 0


def test_candidates_and_viterbi():
    assert "могут" in scan.candidates("rnогут") and "блок" in scan.candidates("бл*ок") and "ко" not in scan.candidates("кот")
    assert "курсы" in scan.candidates("курсьl") and "комиссия" in scan.candidates("кoмиссия")
    lattice = [[("a", 0.0, 5, 5)], [("b", -1.0, 9, 9), ("c", -1.0, 3, 3)], [("d", 0.0, 5, 5)]]
    assert scan._viterbi(lattice, {}, 100) == ["a", "b", "d"] and scan._viterbi(lattice, {("a", "c"): 3}, 100) == ["a", "c", "d"]


def test_bare_numbers_that_count_up():
    text = "\n".join(["слово"] * 5 + ["7"] + ["слово"] * 5 + ["8"] + ["слово", "", "2020", "31", "", "слово", "9"])
    assert [i for i, k in scan.structure(text, set())[1].items() if k == "page_number"] == [5, 11, 18]


def test_header_of_one_document(spark):
    page = ["слово за словом идёт по строке", "и ещё одна строка текста", ""]
    text = "\n".join(x for n in (1, 2, 3) for x in ["Устав лицея", *page, "Общие правила", *page, f"— {n} —"])
    docs = spark.createDataFrame([(1, " ".join(page) + " устав лицея общие правила", text)], "doc_id long, text string, extracted_text string")
    got = {(r["line_no"], r["kind"]) for r in scan.found_noise(docs).collect()}
    assert got == {(n, "header") for n in (9, 18)} | {(0, "header")} | {(n, "page_number") for n in (8, 17, 26)}


def test_neighbouring_misread_words_are_chosen_together(spark):
    texts = ["кит дым"] * 3 + ["кот"] * 4 + ["дом"] * 4 + ["вот", "там"] * 4  # each alone is more frequent as another word
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)] + [(100, None, "вот к~т д~м там")], "doc_id long, text string, extracted_text string")
    assert scan.repaired_texts(docs).head()["repaired"] == "вот кит дым там"


def test_copies_of_a_scan_dont_make_its_misread_words_usual(spark):
    base = docs(spark).drop("line")
    bad = base.where("doc_id = 2").head()["extracted_text"]
    copies = spark.createDataFrame([(1000 + i, None, bad) for i in range(40)], "doc_id long, text string, extracted_text string")
    got = scan.found_noise(base.unionByName(copies)).where("doc_id in (2, 1000, 1039)").collect()
    rows = {}
    for r in got:
        rows.setdefault(r["doc_id"], set()).add((r["line_no"], r["kind"]))
    assert rows[2] == rows[1000] == rows[1039] == {(0, "header"), (5, "header"), (4, "page_number"), (13, "page_number"), (1, "hyphen"), (2, "misread"), (3, "misread"), (8, "misread")}
