import pytest
from pyspark.sql import functions as F

from ladoga.functions import text as T
from ladoga.operators import chunking, grounding
from ladoga.sources import files, html


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "text string").select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value,want", [("Как ПОСТУПИТЬ?!", "как поступить"), ("Кто ведёт: «алгебру»-1", "кто ведет алгебру 1"), ("  a — b/c  ", "a b c"), ("", ""), (None, None)]
)
def test_normalize(spark, value, want):
    assert one(spark, value, T.normalize("text")) == want


def test_scalars(spark):
    assert one(spark, "какие экзамены для для 9 класса", T.question_terms("text")) == ["какие", "экзамены", "класса"]
    assert one(spark, "код 54.02.01 и 04.09.2026, 1.54.02.01", T.found("text", T.CODE)) == ["54.02.01"]
    assert one(spark, "Первое. Второе! Срок 5. июня", T.sentences("text")) == ["Первое.", "Второе!", "Срок 5. июня"]
    assert one(spark, "+7 (900) 123-45-67", T.phone_digits(F.col("text"))) == "9001234567"
    assert one(spark, "экзаменами", T.stem(F.col("text"))) == "экзамен" and one(spark, "дом", T.stem(F.col("text"))) == "дом"
    assert one(spark, "https://a.example/news/open-day-12/", T.title_from_url("text")) == "open day"
    assert one(spark, "первый длинный вопрос и второй длинный вопрос", T.compound_parts("text")) == ["первый длинный вопрос", "второй длинный вопрос"]
    assert one(spark, "Кто такой Иван Петров", T.proper_nouns("text")) == ["Иван", "Петров"]


def test_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(1700))
    df = spark.createDataFrame([(1, text, "c"), (2, "short", "c"), (3, None, "c"), (4, "", "c")], "id long, text string, start string")
    got = [(r["id"], r["start"], len(r["text"])) for r in chunking.fixed_windows(df).orderBy("id", "start").collect()]
    assert got == [(1, 0, 800), (1, 700, 800), (1, 1400, 300)]
    rows = chunking.paragraphs(spark.createDataFrame([(1, "ab\n\n" + "c" * 60 + "\n \n" + "tail")], "id long, text string")).collect()
    assert [r["text"] for r in rows] == ["ab\n" + "c" * 60, "tail"]
    lines = chunking.records(spark.createDataFrame([(1, "x\n# a\nb\n# c")], "id long, text string"), "^#").orderBy("line_no").collect()
    assert [r["record"] for r in lines] == [0, 1, 1, 2]


PAGE = """<html><head><title>t</title><script>var x = "<h2>no</h2>";</script></head><body><nav><a href="/n">n</a></nav>lost
<h1>One</h1><p>first <b>bold</b></p><h3>Deep</h3>text<h2>Two</h2><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td></td></tr></table>
<a href="doc.pdf">d</a><a href="#x">x</a><a href="doc.pdf">d</a></body></html>"""


def test_html(spark):
    sections, tables, links = html.parse(PAGE, "https://a.example/p/")
    assert [(lv, t, above) for lv, t, above, _ in sections] == [(1, "One", ["One"]), (3, "Deep", ["One", "Deep"]), (2, "Two", ["One", "Two"])]
    assert sections[0][3] == "first bold" and tables == [[["A", "B"], ["1", ""]]]
    assert links == ["https://a.example/n", "https://a.example/p/doc.pdf"]
    df = html.structures(spark.createDataFrame([(1, "https://a.example/p/", PAGE), (2, None, None)], "id long, url string, html string"))
    assert html.sections(df).count() == 3 and [r["line"] for r in html.table_lines(df).collect()] == ["A: 1; B"]


def test_files(spark, tmp_path):
    assert files.decode("Привет".encode("cp1251")) == "Привет" and files.decode("Привет".encode()) == "Привет"
    assert files.decode(b'<meta charset="koi8-r">' + "Да".encode("koi8-r")).endswith("Да") and files.decode(None) is None
    assert files.pdf_text(b"%PDF BT (Hello \\(world\\), this is a line of text) Tj (and one more string) Tj ET") == "Hello (world), this is a line of text and one more string"
    (tmp_path / "a.html").write_bytes("текст".encode("cp1251"))
    (tmp_path / "b.pdf").write_bytes(b"BT\n(multi\n) Tj\nET and some readable words in between here")
    got = {r["path"][-6:]: r["text"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.html"] == "текст" and "readable words" in got["/b.pdf"]


def test_claims(spark):
    said = spark.createDataFrame([(1, "Код 54.02.01, цена 12 500 рублей, +7 900 123-45-67, a@b.example, 01.09.2025"), (2, None), (3, "нет")], "id long, text string")
    seen = spark.createDataFrame([(1, "специальность 54.02.01; 12500 руб; 12 500 рублей; тел. 8 (900) 123-45-67"), (9, "x")], "id long, text string")
    got = {r["kind"]: r["supported"] for r in grounding.supported(grounding.claims(said), seen).collect()}
    assert got == {"code": True, "money": True, "phone": True, "mail": False, "date": False}
    loose = {r["kind"]: r["supported"] for r in grounding.supported(grounding.claims(said), seen, strict=False).collect()}
    assert loose["code"] is False  # signs within the code are gone from the normalised evidence


def test_section_fragments(spark):
    rows = [(1, 0, "A", ["A"], "x" * 30), (1, 1, "B 54.02.01", ["A", "B 54.02.01"], "слово " * 200), (2, 0, "C", ["C"], ""), (1, 2, "D", ["A", "D"], "y" * 60 + " 2025/2026")]
    df = spark.createDataFrame(rows, "id long, position int, title string, parent_titles array<string>, text string")
    got = chunking.section_fragments(df).orderBy("id", "chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and {r["title"] for r in got} == {"B 54.02.01", "D"}
    assert max(len(r["text"]) for r in got) <= 600 and got[0]["code"] == "54.02.01" and got[-1]["year"] == "2025/2026"


def test_pdf_arrays_of_strings():
    assert files.pdf_text(b"BT [(Hel) -20 (lo) -350 (wor) (ld of text that is long enough to be taken as it is)] TJ ET") == "Hello world of text that is long enough to be taken as it is"


def test_empty_cells_may_be_dropped(spark):
    df = spark.createDataFrame([(1, [[["a", "b", "c"], ["1", "", "3"]]])], "id long, tables array<array<array<string>>>")
    assert html.table_lines(df).head()["line"] == "a: 1; b; c: 3" and html.table_lines(df, keep_empty=False).head()["line"] == "a: 1; b: 3; c"
