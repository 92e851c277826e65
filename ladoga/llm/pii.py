"""Personal data in free text: names, phones, mail addresses, identity numbers and street addresses.

Method: regular expressions propose spans, checksum validators confirm the numbers that have one (insurance number
modulo 101, tax number modulo 11, payment card by Luhn, bank account by modulo 97), words near a span raise or lower
its score, and spans that score enough are kept, the better one where two overlap. Which words are given names is read
off the texts: words that stand before patronymics, or beside several surnames and seldom elsewhere, in any of their
cases; a list of common ones is only where that starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladoga.workspace import cut, once

# Common given names (Russian in the nominative, then as written in Latin letters).
GIVEN = """анна анастасия алина алла ангелина антонина валентина валерия варвара василиса вера вероника виктория галина
дарья диана ева евгения екатерина елена елизавета жанна зинаида зоя инга инна ирина карина кира клавдия кристина ксения
лариса лидия лилия любовь людмила маргарита марина мария мила милана надежда наталья нина оксана ольга полина раиса римма
светлана софия софья тамара татьяна ульяна юлия яна александр алексей анатолий андрей антон аркадий арсений артём артур
богдан борис вадим валентин валерий василий виктор виталий владимир владислав всеволод вячеслав геннадий георгий герман
глеб григорий даниил данила денис дмитрий евгений егор иван игнат игорь илья кирилл константин лев леонид макар максим
марат марк матвей михаил никита николай олег павел пётр роман руслан святослав семён сергей станислав степан тарас тимофей
тимур фёдор филипп эдуард юрий яков ярослав
anna anastasia alina daria darya diana ekaterina elena irina inga julia ksenia liliya maria marina natalia olga polina
sofia svetlana tatiana ulyana vera yulia alexander alexey andrey anton artem boris denis dmitry gleb igor ivan kirill lev
maxim mikhail nikita nikolay oleg pavel petr peter roman sergey stepan taras timur vladimir yuri""".split()
OBLIQUE = {"лев": "льв", "пётр": "петр", "павел": "павл", "любовь": "любов"}


def _forms(name: str) -> set[str]:
    """A given name in all its cases, with and without the dots over ё."""
    if name[0] < "а":
        return {name}
    stem, out = OBLIQUE.get(name, name), {name}
    if name[-1] in "ая":
        out |= {name[:-1] + e for e in ("а", "ы", "и", "е", "у", "ой", "ою", "я", "ю", "ей", "ею")}
        out = {w for w in out if not w.endswith("яа")}
    elif name[-1] in "йь":
        out |= {name[:-1] + e for e in ("я", "ю", "ем", "ём", "е", "и", "ью")} | {stem + e for e in ("и", "ью")}
    else:
        out |= {stem + e for e in ("а", "у", "ом", "е")}
    return out | {w.replace("ё", "е") for w in out}


NAMES = frozenset().union(*map(_forms, GIVEN))
#: A word is a given name if it stands before this many patronymics, or beside this many surnames, and this share of its
#: occurrences is of that kind. Up to so many names are sent along; if there are more, each text gets those that it has.
PATRONYMICS, SURNAMES, SHARE = 2, 3, 0.6
MOST_NAMES = 50_000
_W = r"[^\W\d_]"
_PATRONYMIC = r"(?:ович|евич|ич)(?:а|у|ем|е)?|(?:овн|евн|ичн|иничн)(?:а|ы|е|у|ой)"
_SURNAME = r"(?:[оеё]в|[иы]н)(?:а|у|ым|ом|е|ой|ых|ы|ою)?|(?:ск|цк)(?:ий|ого|ому|им|ом|ая|ой|ую)|(?:ук|юк|енко|ян|дзе|швили)"
_LATIN_SURNAME = r"(?:[eo]v|[iy]n|sk[iy]y?|tsk[iy]y?|enko|uk|yan)(?:a|aya)?"
RE_SURNAME = re.compile(rf"(?:{_W}{{2,}}(?:{_SURNAME})|{_W}{{2,}}{_LATIN_SURNAME})(?:-{_W}+)?", re.I)
RE_PATRONYMIC = re.compile(rf"{_W}{{2,}}(?:{_PATRONYMIC})", re.I)
RE_WORD = re.compile(rf"{_W}+(?:[-’']{_W}+)*")
RE_INITIALS = re.compile(rf"(?<![\w.]){_W}\.[  ]?{_W}\.[  ]?(?={_W}{{3,}})|(?<= ){_W}\.[  ]?{_W}\.(?!{_W})")

RE_MAIL = re.compile(r"(?<![\w.+-])[\w][\w.+-]*[ ]?(?:@|\(at\)|\[at\]|\(собака\)|\[собака\])[ ]?[\w-]+(?:\.[\w-]+)+", re.I)
_SEP = r"[  .\-]?"
RE_PHONE = re.compile(
    rf"(?<![\w.+-])(?:(?:\+7|8|7){_SEP}\(?\d{{3}}\)?{_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}"
    rf"|\(\d{{3}}\){_SEP}\d{{3}}{_SEP}\d{{2}}{_SEP}\d{{2}}"
    rf"|\d{{3}}[  .-]\d{{3}}[  .-]\d{{2}}[  .-]?\d{{2}}"
    rf"|\+\d{{1,3}}(?:[  .()\-]{{0,2}}\d){{7,12}})(?![\w]|[-.]\d)"
)
RE_INSURANCE = re.compile(r"(?<![\w.+-])\d{3}[- ]?\d{3}[- ]?\d{3}[- ]?\d{2}(?![\w]|[-.]\d)")
RE_TAX = re.compile(r"(?<![\w.+-])(?:\d{12}|\d{10})(?![\w]|[-.]\d)")
RE_PASSPORT = re.compile(r"(?<![\w.+-])\d{2} ?\d{2}(?: ?№ ?| )?\d{6}(?![\w]|[-.]\d)")
RE_CARD = re.compile(r"(?<![\w.+-])\d{4}(?:[ -]?\d{4}){3}(?![\w]|[-.]\d)")
RE_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")

_STREET = r"(?:ул(?:ица|ице|ицы|ицу)?|просп(?:ект|екте|екта)?|пр-т|пер(?:еулок|еулке|еулка)?|пл(?:ощадь|ощади)?|бульвар|б-р|шоссе|наб(?:ережная|ережной)?|проезд|тупик)(?!\w)"
_TOWN = r"(?:г|гор|город|городе|пос|посёлок|поселок|село|дер|деревня|пгт|ст|станица)(?!\w)"
_NAME = rf"{_W}+(?:-{_W}+)?"
_HOUSE = r"(?:д(?:ом)?(?!\w)\.? ?)?\d+(?:[/-]\d+)?[а-я]?(?!\w)(?:,? ?(?:кв(?:артира)?|корп(?:ус)?|к|стр(?:оение)?|оф(?:ис)?)(?!\w)\.? ?\d+)*"
RE_ADDRESS = re.compile(
    rf"(?<![\w-])(?:\d{{6}}, ?)?(?:{_TOWN}\.? ?{_NAME}(?: {_NAME})?, ?)?"
    rf"(?:{_STREET}\.? ?{_NAME}(?: {_NAME})?|{_NAME}(?:ая|ый|ий|ой|ое|ой) {_STREET}),? ?{_HOUSE}",
    re.I,
)
RE_ADDRESS_LATIN = re.compile(rf"(?<![\w-])(?:\d+[a-z]?,? (?:{_W}+ ){{1,3}}(?:street|st|road|rd|avenue|ave|lane|square)\b|{_W}{{3,}}(?:straße|strasse|weg|platz|gasse) \d+)", re.I)

# Words near a span that speak for or against a kind.
FOR_ID = re.compile(r"снилс|страхов|инн(?!\w)|пасп(?:\.|орт)|серия|удостоверени|документа?(?!\w)|мои данные|passport|insurance|\btax\b|ausweis", re.I)
FOR_PHONE = re.compile(r"тел|моб|номер|звон|phone|mobile|call", re.I)
FOR_ADDRESS = re.compile(r"адрес|живу|жив[её]т|прожива|прописк|прописан|регистрац|получател|address|live|wohn", re.I)
FOR_NAME = re.compile(r"зовут|фио(?!\w)|имя|фамили|от имени|заявлени|господин|госпож|name|dear|herr|frau", re.I)
#: What stands before a number or a place that belongs to no person.
NO_PERSON = re.compile(r"(?:остановк|станци|выставк|экскурси|маршрут|памятник)\w*[^.!?\n]{0,12}$", re.I)
AGAINST = re.compile(r"(?:заявк|заказ|код|квитанц|счёт|счет|приказ|артикул|договор|order|invoice|ticket|code)\w*[\s:№#]{0,3}$", re.I)


def insurance_ok(d: str) -> bool:
    """Insurance number: the weighted digits modulo 101."""
    s = sum(int(x) * (9 - i) for i, x in enumerate(d[:9])) % 101
    return len(d) == 11 and s % 100 == int(d[9:])


def tax_ok(d: str) -> bool:
    """Tax number of a person (12 digits) or a firm (10): one or two control digits modulo 11."""
    w = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
    c = lambda n: sum(int(x) * k for x, k in zip(d[:n], w[-n:])) % 11 % 10
    return c(9) == int(d[9]) if len(d) == 10 else len(d) == 12 and (c(10), c(11)) == (int(d[10]), int(d[11]))


def luhn_ok(d: str) -> bool:
    return sum(int(x) if i % 2 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1], 1)) % 10 == 0


def account_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


_ENDING = re.compile(r"(?:ой|ою|ей|ею|ом|ем|ём|ью|а|я|ы|и|е|у|ю|й|ь)$")


def name_stem(word: str) -> str:
    """What the cases of a name have in common."""
    return _ENDING.sub("", word.lower().replace("ё", "е"))


def name_evidence(text: str) -> list[tuple[str, str]]:
    """``stem, beside``: of each word that may be a given name the patronymic (after ``+``) or surname it adjoins, or None
    where it adjoins neither. Only words with one capital, the first letter, count."""
    words = [(w.start(), w.end(), w.group()) for w in RE_WORD.finditer(text)]
    kind = ["p" if RE_PATRONYMIC.fullmatch(w) else "s" if RE_SURNAME.fullmatch(w) else "" for _, _, w in words]
    out = []
    for i, (a, b, w) in enumerate(words):
        if len(w) < 3 or kind[i] == "p" or "-" in w or not w.istitle():
            continue
        adjoins = lambda j: 0 <= j < len(words) and text[words[min(i, j)][1] : words[max(i, j)][0]] in (" ", "\xa0") and words[j][2].istitle()  # noqa: E731, B023
        if adjoins(i + 1) and kind[i + 1] == "p":
            out.append((name_stem(w), "+" + name_stem(words[i + 1][2])))
        elif not kind[i]:
            near = next((words[j][2] for j in (i + 1, i - 1) if adjoins(j) and kind[j] == "s"), None)
            out.append((name_stem(w), None if near is None else name_stem(near)))
    return out


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame([x for t in pdf["text"] if t for x in name_evidence(t)], columns=["stem", "beside"])


def learned_names(texts: DataFrame) -> DataFrame:
    """``stem`` of each given name that the texts show; those of the list among them. Equal texts count once."""
    each = once(texts.where("text is not null").select("text", F.xxhash64("text").alias("hash")), "hash").select("text").mapInPandas(_evidence, "stem string, beside string")
    by = each.groupBy("stem", "beside").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("stem").agg(
        F.sum("n").alias("all"), F.sum(F.when(F.col("beside").isNotNull(), F.col("n"))).alias("named"),
        F.count(F.when(F.col("beside").startswith("+"), True)).alias("before"), F.count(F.when(~F.col("beside").startswith("+"), True)).alias("surnames"),
    )
    enough = (F.col("before") >= PATRONYMICS) | (F.col("surnames") >= SURNAMES)
    return cut(by.where(enough & (F.length("stem") > 1) & (F.col("named") >= SHARE * F.col("all"))).select("stem"))


def given_names(texts: DataFrame) -> frozenset[str]:
    """The stems of ``learned_names``, all of them."""
    return frozenset(r["stem"] for r in learned_names(texts).collect())


def _names(text: str, learned: frozenset[str] = frozenset()) -> Iterator[tuple[int, int, float]]:
    """Two or more adjoining parts of a name, of which one is a known given name, a patronymic or initials."""
    taken = 0
    given = lambda w: w.lower() in NAMES or len(w) > 2 and name_stem(w) in learned
    for m in RE_INITIALS.finditer(text):
        low, high = m.start(), m.end()
        if (after := RE_WORD.match(text, high)) and RE_SURNAME.fullmatch(after.group()):
            yield low, after.end(), 3
            continue
        before = re.search(rf"(?<!\w)({_W}+(?:-{_W}+)?)[  ]$", text[max(0, low - 40) : low])
        if before and RE_SURNAME.fullmatch(before.group(1)):
            yield low - len(before.group()), high, 3
    words = [(w.start(), w.end(), w.group()) for w in RE_WORD.finditer(text)]
    kind = [
        "p" if RE_PATRONYMIC.fullmatch(w) and w.lower() not in NAMES else "g" if given(w) else "s" if RE_SURNAME.fullmatch(w) else ""
        for _, _, w in words
    ]
    i = 0
    while i < len(words):
        best = 0
        for pattern in ("gps", "sgp", "gp", "gs", "sg"):
            n = len(pattern)
            if "".join(kind[i : i + n]) == pattern and all(text[words[k][1] : words[k + 1][0]] in (" ", " ") for k in range(i, i + n - 1)):
                best = max(best, n)
        if best and words[i][0] >= taken:
            capital = all(w[2][0].isupper() for w in words[i : i + best]) or all(w[2][0].islower() for w in words[i : i + best])
            if capital:
                yield words[i][0], words[i + best - 1][1], 2.0 + best
                i += best
                continue
        i += 1


def find_spans(text: str, learned: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the personal data in one text, in order, none overlapping."""
    out: list[tuple[float, str, int, int]] = []
    lower = text.lower()
    near = lambda a: re.split(r"[\d\n]", lower[max(0, a - 40) : a])[-1]
    after = lambda b: lower[b : b + 40].partition("\n")[0]
    if "@" in text or "(at)" in lower or "[at]" in lower or "собака" in lower:
        out += [(9, "email", m.start(), m.end()) for m in RE_MAIL.finditer(text)]
    if len(_digits(text)) >= 2:
        for r in (RE_ADDRESS, RE_ADDRESS_LATIN):
            for m in r.finditer(text):
                score = 3.0 + 2.0 * bool(FOR_ADDRESS.search(near(m.start()))) + 0.5 * bool(re.match(r"\d{6}", m.group())) - 1.5 * bool(NO_PERSON.search(near(m.start())))
                if score >= LEAST:
                    out.append((3 + score, "address", m.start(), m.end()))
    if len(_digits(text)) >= 9:
        for r, kind, valid, base in (
            (RE_PHONE, "phone", None, 3.0), (RE_INSURANCE, "idnum", insurance_ok, 1.0), (RE_TAX, "idnum", tax_ok, 0.5),
            (RE_PASSPORT, "idnum", None, 0.5), (RE_CARD, "card", luhn_ok, 1.0), (RE_ACCOUNT, "account", account_ok, 2.0),
        ):
            for m in r.finditer(text):
                score = base
                if valid:
                    ok = valid(m.group() if kind == "account" else _digits(m.group()))
                    if not ok and kind in ("card", "account"):
                        continue
                    score += 2.0 if ok else -1.0
                if kind == "idnum":
                    score += 2.5 if FOR_ID.search(near(m.start())[-30:]) or FOR_ID.search(re.split(r"[\d.?!]", after(m.end()))[0]) else 0
                if kind == "phone":
                    score += 1.0 if FOR_PHONE.search(near(m.start())[-20:]) else 0
                    score -= 2.5 if re.search(r"снилс|страхов|инн(?!\w)|пасп", near(m.start())[-25:]) or re.match(r"[ ,—–-]{0,3}(?:это )?номер (?:\w+ )?документа", after(m.end())) else 0
                if AGAINST.search(near(m.start())[-15:]):
                    score -= 2.5
                if score >= LEAST:
                    out.append((score, kind, m.start(), m.end()))
    out += [(s + bool(FOR_NAME.search(near(a))), "name", a, b) for a, b, s in _names(text, learned)]
    kept: list[tuple[str, int, int]] = []
    for _, kind, a, b in sorted(out, key=lambda x: (-x[0], x[2] - x[3], x[2])):
        if all(b <= c or a >= d for _, c, d in kept):
            kept.append((kind, a, b))
    return sorted(kept, key=lambda x: x[1])


#: A span is kept if it scores so much.
LEAST = 2.0

KINDS = ("name", "phone", "email", "idnum", "address")


def _stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(a, b, s) for a, b, t in zip(pdf["tbl"], pdf["rec_id"], pdf["text"]) if t for s in {name_stem(w) for w in RE_WORD.findall(t) if len(w) > 2}]
        yield pd.DataFrame(rows, columns=["tbl", "rec_id", "stem"]).astype({"rec_id": "Int64"})


def _with_names(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` with ``stems``, those of the names that each text has; null if it has none."""
    words = texts.select("tbl", "rec_id", "text").mapInPandas(_stems, "tbl string, rec_id long, stem string")
    own = words.join(names, "stem").groupBy(F.col("tbl").alias("of_tbl"), F.col("rec_id").alias("of_id")).agg(F.collect_set("stem").alias("stems"))
    return texts.join(own, F.col("tbl").eqNullSafe(F.col("of_tbl")) & F.col("rec_id").eqNullSafe(F.col("of_id")), "left").drop("of_tbl", "of_id")


def _spans(names: "object" = None):
    """With ``names`` for all texts, or the ``stems`` of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            learned = [names.value] * len(pdf) if names else [frozenset() if s is None else frozenset(s) for s in pdf["stems"]]
            found = [find_spans(t, n) if t else [] for t, n in zip(pdf["text"], learned)]
            clean = []
            for text, spans in zip(pdf["text"], found):
                for kind, a, b in reversed(spans):
                    text = f"{text[:a]}[{kind.upper()}]{text[b:]}"
                clean.append(text)
            rows = [[{"kind": k, "start_pos": a, "end_pos": b} for k, a, b in s] for s in found]
            yield pd.DataFrame({"tbl": pdf["tbl"], "rec_id": pdf["rec_id"], "redacted": clean, "spans": rows})

    return run


def redact(texts: DataFrame) -> DataFrame:
    """``tbl, rec_id, text`` to ``tbl, rec_id, redacted, spans``.

    A null text gives a null ``redacted`` and no spans, an empty one stays empty; repeated rows give one row. Every text
    is worked on by itself, so no group of equal keys ever meets in one task.
    """
    schema = "tbl string, rec_id long, redacted string, spans array<struct<kind: string, start_pos: int, end_pos: int>>"
    texts = once(texts.select("tbl", F.col("rec_id").cast("long").alias("rec_id"), "text"), "tbl", "rec_id")
    names = learned_names(texts)
    if names.count() > MOST_NAMES:
        return _with_names(texts, names).mapInPandas(_spans(), schema)
    learned = frozenset(r["stem"] for r in names.collect())
    return texts.mapInPandas(_spans(texts.sparkSession.sparkContext.broadcast(learned)), schema)


def found_spans(texts: DataFrame) -> DataFrame:
    """``tbl, rec_id, kind, start_pos, end_pos``: one row per item."""
    return redact(texts).select("tbl", "rec_id", F.explode("spans").alias("s")).select("tbl", "rec_id", "s.*")
