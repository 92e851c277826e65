import pytest

from ladoga.llm import pii


def insurance(base="123456789"):
    s = sum(int(x) * (9 - i) for i, x in enumerate(base)) % 101 % 100
    return base + f"{s:02d}"


def tax(base="5001007322"):
    w = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    for n in (10, 11):
        base += str(sum(int(x) * k for x, k in zip(base[:n], w[-n:])) % 11 % 10)
    return base


def spans(text):
    return [(k, text[a:b]) for k, a, b in pii.find_spans(text)]


CASES = [
    ("Меня зовут Инга Олеговна Крутоберегова, жду", [("name", "Инга Олеговна Крутоберегова")]),
    ("заявление от мшанникова глеба", [("name", "мшанникова глеба")]),
    ("Есть ли приём у Рудокамнева Г. Д. и А.О. Дальнополевой?", [("name", "Рудокамнева Г. Д."), ("name", "А.О. Дальнополевой")]),
    ("This is Anna Veligorova, hello", [("name", "Anna Veligorova")]),
    ("Группа ПД-19 и Центр Карьеры Вершина", []),
    ("звоните +7 (217) 799-31-53 или 8-261-529-45-37", [("phone", "+7 (217) 799-31-53"), ("phone", "8-261-529-45-37")]),
    ("тел. (262) 4944335, 230-626-86-55", [("phone", "(262) 4944335"), ("phone", "230-626-86-55")]),
    ("Заявка 7937662483 принята, код 3860 927433", []),
    ("паспорт 47 00 № 164093", [("idnum", "47 00 № 164093")]),
    (f"СНИЛС: {insurance()[:3]}-{insurance()[3:6]}-{insurance()[6:9]} {insurance()[9:]}", [("idnum", f"{insurance()[:3]}-{insurance()[3:6]}-{insurance()[6:9]} {insurance()[9:]}")]),
    (f"мой ИНН {tax()}, тел. 82768427907", [("idnum", tax()), ("phone", "82768427907")]),
    ("пишите a_b+c @ mail.test или anna[собака]mail.test, страница @kolos", [("email", "a_b+c @ mail.test"), ("email", "anna[собака]mail.test")]),
    ("живу: 187636, г. Заозёрный Лог, ул. Ключевая, д. 97, кв. 140?", [("address", "187636, г. Заозёрный Лог, ул. Ключевая, д. 97, кв. 140")]),
    ("прописка Ветряная улица, 30-40, что дальше", [("address", "Ветряная улица, 30-40")]),
    ("Где 3 корпус и кабинет 374, это дом 9 этаж 1?", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_examples(text, want):
    assert spans(text) == want


def test_checksums():
    assert pii.insurance_ok(insurance()) and not pii.insurance_ok("12345678900")
    assert pii.tax_ok(tax()) and not pii.tax_ok("1" * 12)
    assert pii.luhn_ok("4539578763621486") and not pii.luhn_ok("4539578763621487")
    assert pii.account_ok("GB82 WEST 1234 5698 7654 32") and not pii.account_ok("GB83 WEST 1234 5698 7654 32")


def test_on_tables(spark):
    rows = [("a", 1, "зовут Вера Крутоберегова, тел. 8 276 985 12 99"), ("a", 1, "зовут Вера Крутоберегова, тел. 8 276 985 12 99"), ("a", 2, None), ("a", 3, ""), ("b", 1, "слово " * 50_000 + "x@y.example")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "tbl string, rec_id long, text string, kind int")
    got = {(r["tbl"], r["rec_id"]): r["redacted"] for r in pii.redact(df).collect()}
    assert got["a", 1] == "зовут [NAME], тел. [PHONE]" and got["a", 2] is None and got["a", 3] == "" and got["b", 1].endswith(" [EMAIL]")
    assert sorted((r["kind"], r["start_pos"]) for r in pii.found_spans(df).where("tbl = 'a'").collect()) == [("name", 6), ("phone", 31)]
    assert pii.found_spans(df.limit(0)).count() == 0


def test_names_outside_the_list_are_learned_from_the_texts(spark):
    surnames = ["Громовой", "Ветровой", "Лесовой", "Озеровой"]
    rows = [(f"t{i}", i, f"Заявление от Зульфии {s}, тел. 8-201-478-53-8{i}") for i, s in enumerate(surnames)] + [("q", 1, "меня зовут зульфия ветрова"), ("q", 2, "Где Библиотека Громова?"), ("q", 3, None), ("q", 4, "")]
    texts = spark.createDataFrame([(*r, "x") for r in rows], "tbl string, rec_id long, text string, spans string")
    assert "зульфия" not in pii.NAMES and pii.given_names(texts) == {"зульфи"}
    got = {(r["tbl"], r["rec_id"]): r["redacted"] for r in pii.redact(texts).collect()}
    assert got["q", 1] == "меня зовут [NAME]" and got["t0", 0] == "Заявление от [NAME], тел. [PHONE]" and got["q", 2] == "Где Библиотека Громова?"
    assert got["q", 3] is None and got["q", 4] == ""
    assert pii.given_names(texts.limit(0)) == frozenset()


def test_words_nearby_decide_about_addresses_and_numbers():
    assert [k for k, *_ in pii.find_spans("живу по адресу ул. Заречная, 46/5")] == ["address"]
    assert pii.find_spans("выставка на ул. Заречная, 46") == []
    assert [k for k, *_ in pii.find_spans("4510 123456 — номер документа")] == ["idnum"] and pii.find_spans("4510 123456 — 5 штук") == []


def test_more_names_than_are_sent_along_are_all_used(spark, monkeypatch):
    names = ["Зульфии", "Гульнары", "Айгули"]
    rows = [(f"t{n}", i, f"Заявление от {n} {s}") for n in names for i, s in enumerate(["Громовой", "Ветровой", "Лесовой"])]
    rows += [("q", 1, "меня зовут зульфия ветрова и гульнара громова"), ("q", None, "это айгуль лесова"), (None, None, "тут гульнара ветрова"), ("q", 3, None), ("q", 4, ""), ("q", 1, "меня зовут зульфия ветрова и гульнара громова")]
    texts = spark.createDataFrame(rows, "tbl string, rec_id long, text string")
    want = sorted(map(str, pii.redact(texts).collect()))
    monkeypatch.setattr(pii, "MOST_NAMES", 1)
    assert sorted(map(str, pii.redact(texts).collect())) == want and len(want) == 14
    assert sum("[NAME] и [NAME]" in r or "это [NAME]" in r or "тут [NAME]" in r for r in want) == 3
