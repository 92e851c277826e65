import os
import subprocess
import sys

import pytest

from ladoga.llm import encoding

RU = "хочу узнать когда начинается приём документов и сколько стоит обучение в колледже для выпускников школы какие экзамены нужно сдать чтобы поступить на специальность № и где посмотреть расписание".split()
EN = "when does the library open and where is the café for visitors of the college since the office is closed “today” —".split()
DE = "wo finde ich die praktische prüfung für gäste und die bücherei der schule".split()


def corpus():
    """Five texts of each language; equal ones would count once."""
    return [(lang, f"{i} {' '.join(words)}") for lang, words in (("ru", RU), ("en", EN), ("de", DE)) for i in range(5)] + [(None, None), ("ru", "")]


@pytest.fixture(scope="module")
def scorer():
    return encoding.Scorer({"ru": RU, "en": EN, "de": DE})


RUSSIAN = "Хочу узнать, когда начинается приём документов и сколько стоит обучение?"


@pytest.mark.parametrize(
    "chain", [[("utf_8", "cp1251")], [("utf_8", "cp866")], [("utf_8", "latin_1")], [("cp1251", "latin_1")], [("cp1251", "koi8_r")], [("koi8_r", "cp1251")], [("cp866", "cp1251")], [("utf_8", "cp1251")] * 2]
)
def test_round_trip(scorer, chain):
    text = RUSSIAN.replace("И", "и") if len(chain) < 2 else "сколько стоит обучение?"
    bad = text
    for enc, dec in chain:
        try:
            bad = bad.encode(enc).decode(dec)
        except UnicodeDecodeError:
            pytest.skip("bytes without a character")
    found, good, used = encoding.repair(bad, scorer)
    assert found and used and good == text


def test_in_places_and_other_languages(scorer):
    assert encoding.repair("когда " + "начинается".encode("cp1251").decode("cp1252") + " приём?", scorer)[:2] == (True, "когда начинается приём?")
    assert encoding.repair("wo ist die " + "prüfung für gäste".encode().decode("cp1252") + "?", scorer)[:2] == (True, "wo ist die prüfung für gäste?")
    assert encoding.repair("the library â€” open", scorer)[:2] == (True, "the library — open")


@pytest.mark.parametrize("lost", ["Где посмо��еть расписание", "?????? ????? 7 ????", "when does the caf? ?toile open"])
def test_lost_letters_are_reported(scorer, lost):
    assert encoding.repair(lost, scorer)[0]


@pytest.mark.parametrize("clean", ["", "plain text????", RUSSIAN, "rfrjq ghj[jlyjq ,fkk?", "&quot;срочно&quot;", "café “Étoile” für Gäste", "Ғылыми үйірме бейсенбі", "Kakie ekzameny 😅 — «да»", "https://a.example/?q=1&b=2", "Кто?", "приём " * 20_000])
def test_clean_text_stays(scorer, clean):
    assert encoding.repair(clean, scorer) == (False, clean, [])


@pytest.mark.parametrize("end", [" ? Спасибо", "?Когда обед", " ?как поступить", " ???", "?? А где", " ?", "????", "?! Где"])
def test_loose_question_marks_are_typed(scorer, end):
    text = RUSSIAN.rstrip("?") + end
    assert encoding.repair(text, scorer) == (False, text, [])


def test_a_lost_letter_comes_back_where_one_word_fits(scorer):
    assert encoding.repair("where is the caf� for visitors", scorer)[:2] == (True, "where is the café for visitors")


@pytest.mark.parametrize("sign", ["€", "№ 5", "“today”", "«да»", "café", "\xa0— \xa0®"])
def test_signs_that_are_bytes_of_letters_elsewhere_stay(spark, sign):
    # the letters are far more frequent than the signs
    docs = spark.createDataFrame([("ru", f"{i} а й т у ь р щ") for i in range(400)] + [("", f"{i} it still {sign} open") for i in range(5)], "lang string, text string")
    sc = encoding.Scorer(encoding.model(docs))
    assert encoding.repair(f"it still {sign} open?", sc) == (False, f"it still {sign} open?", [])


def test_compressed_size_decides(scorer):
    bad = "когда " + "начинается приём".encode("cp1251").decode("koi8_r") + " в колледже?"
    assert encoding.repair(bad, scorer)[0]
    plain = encoding.Scorer({"ru": RU, "en": EN, "de": DE})
    plain.cost = lambda text: float(len(text.encode()))
    assert not encoding.repair(bad, plain)[0]


def test_vocabulary_is_cut_by_count(spark):
    docs = spark.createDataFrame([("ru", "раз " * 9 + "два " * 8 + "три " * 7 + "пять " * 7), (None, "раз " * 3), (None, None)], "lang string, text string")
    got = {(r["lang"], r["word"]): r["n"] for r in encoding.vocabulary(docs, 3).collect()}
    assert got == {("ru", "раз"): 9, ("ru", "два"): 8, ("", "раз"): 3}
    assert len(encoding.vocabulary(docs, 4).collect()) == 5
    assert {(r["word"], r["n"]) for r in encoding.vocabulary(docs.unionByName(docs), 4).collect()} == {("раз", 9), ("два", 8), ("три", 7), ("пять", 7), ("раз", 3)}


def test_many_copies_of_a_garbled_text(spark):
    """A third of all rows are copies of one text with a garbled word; the word it was stays clean everywhere else."""
    bad = "когда начинается " + "обучение".encode("koi8_r").decode("cp1251") + " в колледже?"
    rows = [("t", i, f"{i} когда начинается обучение в колледже?") for i in range(40)] + [("hot", i, bad) for i in range(400)]
    texts = spark.createDataFrame(rows, "tbl string, rec_id long, text string")
    docs = spark.createDataFrame(corpus(), "lang string, text string")
    got = encoding.garbled_records(texts, docs).groupBy("tbl").count().collect()
    assert [(r["tbl"], r["count"]) for r in got] == [("hot", 400)]


def test_code_travels_to_executors(tmp_path):
    """A driver that alone can import the package; its workers start elsewhere."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from ladoga.workspace import local_session
from ladoga.llm import encoding, mainbody
spark = local_session(2, "2g")
texts = spark.createDataFrame([("t", 1, "начинается приём документов".encode().decode("cp1251", "replace"))], "tbl string, rec_id long, text string")
docs = spark.createDataFrame([("ru", f"{{i}} начинается приём документов") for i in range(5)], "lang string, text string")
assert encoding.garbled_records(texts, docs).count() == 1
pages = spark.createDataFrame([(1, 1, "a", "<div><h1>a</h1><p>b</div>", "a\\nb")], "id long, source_id long, title string, raw_html string, clean_text string")
assert mainbody.main_bodies(pages).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300, capture_output=True)


def test_on_tables(spark):
    bad = RUSSIAN.encode().decode("cp1251", "replace")
    rows = [("t", 1, bad), ("t", 1, bad), ("t", 2, RUSSIAN), ("t", 3, None), ("t", 4, ""), ("u", 1, "стоит ��учение")]
    texts = spark.createDataFrame([(*r, "x") for r in rows], "tbl string, rec_id long, text string, lang string")
    docs = spark.createDataFrame(corpus(), "lang string, text string")
    got = {(r["tbl"], r["rec_id"]): r for r in encoding.garbled_records(texts, docs).collect()}
    assert set(got) == {("t", 1), ("u", 1)}
    every = {(r["tbl"], r["rec_id"]): r["restored"] for r in encoding.restored(texts, docs).collect()}
    assert every["t", 3] is None and every["t", 4] == "" and every["t", 2] == RUSSIAN
    assert encoding.garbled_records(texts.limit(0), docs.limit(0)).count() == 0
