"""Noise in text from scanned pages.

Method: noisy-channel correction. Words and pairs of words are counted over all texts of the corpus. A word of a scanned
text that the counts don't know may be a misreading of another: candidates come from a table of confusions of the
recognition, each with its probability; the word as it was read is one of them, with the probability of no confusion. A
line's words are chosen together by Viterbi: probability of the confusions times probability of each word after the one
before it, which backs off to that of the word alone. Words that the counts know have no other candidate, so the lattice
of a line falls into runs of unknown words between known ones, and only these are decoded. Before that, running headers, page numbers and hyphens at line ends are
told from body lines: headers by how often a form of line comes back at borders of pages within one document, or within
documents over all of them; bare page numbers as the longest run of numbers counting up by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladoga.workspace import cut, once

#: What is read -> what may stand on the paper, with the probability of the confusion.
CONFUSIONS: dict[str, tuple[tuple[str, float], ...]] = {
    "0": (("о", 0.02), ("o", 0.02)), "3": (("з", 0.02),), "4": (("ч", 0.02),), "6": (("б", 0.02),), "1": (("i", 0.01), ("l", 0.01), ("1", 0.0)),
    "и": (("н", 0.01),), "н": (("и", 0.003),), "л": (("п", 0.01),), "п": (("л", 0.003),), "ч": (("ц", 0.005),), "ц": (("ч", 0.002),), "щ": (("ш", 0.005),), "ш": (("щ", 0.002),),
    "a": (("а", 0.02),), "e": (("е", 0.02), ("c", 0.003)), "o": (("о", 0.02),), "p": (("р", 0.02),), "c": (("с", 0.02), ("e", 0.01)), "y": (("у", 0.02),), "x": (("х", 0.02),),
    "k": (("к", 0.02),), "m": (("м", 0.02),), "t": (("т", 0.02),), "h": (("н", 0.01),), "b": (("в", 0.01), ("h", 0.01), ("ь", 0.01)), "i": (("l", 0.003), ("і", 0.01)), "l": (("i", 0.003), ("1", 0.005)),
    "а": (("a", 0.01),), "е": (("e", 0.01),), "о": (("o", 0.01), ("0", 0.001)), "р": (("p", 0.01),), "с": (("c", 0.01),), "у": (("y", 0.01),), "х": (("x", 0.01),),
    "5": (("s", 0.005),), "8": (("в", 0.003), ("b", 0.003)), "2": (("z", 0.002),),
    "rn": (("м", 0.01), ("m", 0.01)), "ьl": (("ы", 0.02),), "ь1": (("ы", 0.01),), "ьi": (("ы", 0.01),), "io": (("ю", 0.02),), "lo": (("ю", 0.005),), "cl": (("d", 0.01),), "vv": (("w", 0.005),), "ii": (("п", 0.003), ("u", 0.003)), "li": (("и", 0.002),),
}
NOISE = "~^*|;¦`#_"
INSERTED, REPLACED = 0.01, 0.004
CYRILLIC, LATIN = "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "abcdefghijklmnopqrstuvwxyzäöüßé"
#: The model of a misread word: so many confusions, of which so many are letters replaced by noise; so long, with so much noise.
EDITS, REPLACEMENTS = 3, 2
LONGEST, NOISES = 60, 4
#: A word is known if the texts have it this often; without texts, if scans have it this often and no candidate this many times as often.
KNOWN, KNOWN_IN_SCANS, COMMONER = 2, 3, 6
#: The most frequent words, sent along with their counts so that only the others need a join.
FREQUENT = 50_000
#: Up to so many words, hashes of the whole vocabulary are sent along, and a candidate that is no word goes no further.
HASHES = 1_000_000
#: Words whose candidates one task looks for.
ASKED_PER_TASK = 2_000
#: How often a word that the corpus lacks is taken to occur in it: one as words are, and one with signs or letters of two
#: alphabets in it. A pair of words counts as this many pairs less than its own number once the second's share is added.
UNSEEN, UNSEEN_MIXED = 0.02, 1e-7
BACKOFF = 20.0
#: A form of line is a running header of a document that has it so many times at borders of pages; and of any document if
#: it stands in so many documents and comes back in this share of them.
HEADER_TIMES = 3
HEADER_DOCUMENTS, HEADER_SHARE = 3, 0.3
HYPHENS = "-‐‑­¬"

_FOLD = {c: g[0] for g in "oO0оО зЗ3 чЧ4цЦ бБ6 aAаА eEеЕcCсС pPрР yYуУ xXхХ kKкК нНиИHh мМmM тТtT вВBb лЛпП 1lIiI| шШщЩ".split() for c in g}
_NUMBER = re.compile(r"[\dlIоОoO]*\d[\dlIоОoO]*[.,/]*[\d/]*")


def form(line: str) -> str:
    """A line with numbers masked and confusable characters folded into one."""
    for a, b in (("rn", "m"), ("ьl", "ы"), ("IO", "Ю"), ("io", "ю"), ("cl", "d")):
        line = line.replace(a, b)
    words = ["9" if _NUMBER.fullmatch(w) else w for w in line.split()]
    return "".join(_FOLD.get(c, c.lower()) for c in " ".join(words) if c not in NOISE)


_ALONE = re.compile(r"^\s*(?:\S{1,4}\s{2,})?(.*?)(?:\s{2,}\S{1,4})?\s*$", re.S)


def head_form(line: str) -> str | None:
    """The first two words of a short line that begins with a capital and doesn't end a sentence, as a form."""
    line = line.strip("\x0c\r ")
    if not line or len(line) > 70 or line[-1] in ".,:;!?" + HYPHENS:
        return None
    core = _ALONE.match(line).group(1).lstrip(NOISE)
    if not core or not (core[0].isupper() or core[0].isdigit()) or re.fullmatch(r"\S+ \S{1,4} \S{2,3} \S{1,4}", core):
        return None
    key = " ".join(form(core).split()[:2])
    return key if any(c.isalpha() for c in key) and not key.startswith("9") else None


_N = r"[\dlIОOоoЗз|]{1,4}"
PAGE = re.compile(
    rf"^(?:[—–-]\s*{_N}\s*[—–-]|(?:стр|crp|стp|cтр|cтp|p|pp|с|s)\s?[.,]\s*{_N}|\S{{0,3}}траниц\S{{1,2}}\s+{_N}\s+\S{{2}}\s+{_N}|\w?тр[аa]?[ниH]?\w*цa?\s+{_N}\s+из\s+{_N}|p\S?ge\s+{_N}\s+\S?[оo]f\s+{_N}|seite\s+{_N}\s+von\s+{_N}|{_N}\s?/\s?{_N})$", re.I
)
ROMAN = re.compile(r"^[IVXLC]{1,8}$")
BARE = re.compile(r"^[\dl]{1,3}$")
_NUMBERED = re.compile(rf"^{_N}\s{{2,}}|\s{{2,}}{_N}$")


def structure(text: str, headers: set[str]) -> tuple[list[str], dict[int, str]]:
    """The lines of a text and the kind of those that are a ``header`` or a ``page_number``."""
    lines = text.split("\n")
    plain = [x.strip("\x0c\r \t") for x in lines]
    kinds: dict[int, str] = {}
    numbered = False
    for i, (raw, line) in enumerate(zip(lines, plain)):
        if not line:
            continue
        clean = re.sub(f"[{re.escape(NOISE)}]", "", line) if len(line) < 24 else line
        if ROMAN.match(line) or PAGE.match(clean) or PAGE.match(line):
            kinds[i] = "page_number"
            numbered |= not ROMAN.match(line)
        elif headers and (key := head_form(raw)) in headers:
            kinds[i] = "header"
            numbered |= bool(_NUMBERED.search(line))
    heads = {form(_ALONE.match(plain[i]).group(1)) for i, k in kinds.items() if k == "header"}
    if heads:
        sizes = {len(h) for h in heads}
        for i, line in enumerate(plain):
            if i not in kinds and line and len(line) <= 70 and line[-1] not in ".,;" and any(abs(len(line) - n) <= 6 for n in sizes):
                own = form(_ALONE.match(line).group(1))
                if any(abs(len(own) - len(h)) <= 2 and SequenceMatcher(None, own, h, False).ratio() >= 0.86 for h in heads):
                    kinds[i] = "header"
    if not numbered:
        bare = [(i, int(line.replace("l", "1"))) for i, line in enumerate(plain) if BARE.match(line) and (len(line) == 1 or line[0] != "0")]

        def edge(i: int) -> bool:
            """Whether a page may begin or end at the line."""
            near = [j for j in (i - 1, i + 1) if 0 <= j < len(lines)]
            return (
                len(near) < 2 or any(kinds.get(j) == "header" or "\x0c" in lines[j] for j in near) or "\x0c" in lines[i]
                or not any(plain[i + 1 :]) or not any(plain[:i])
            )

        best: dict[int, tuple[float, list[int]]] = {}
        for i, n in bare:
            before = best.get(n - 1)
            free = not any(0 <= j < len(lines) and re.match(r"^\d[\d ]*$", plain[j]) for j in (i - 1, i + 1))
            score, chain = before if before else (0.0, [])
            score += 1.0 + 1.5 * edge(i) + 0.5 * free
            if n not in best or score >= best[n][0]:
                best[n] = (score, [*chain, i])
        if best:
            score, chain = max(best.values(), key=lambda x: (x[0], -x[1][0]))
            if len(chain) > 1 or score >= 2.5:
                kinds |= {i: "page_number" for i in chain}
    return lines, kinds


_STRIP = ".,:!?()[]«»“”„\"'…–—"


def tokens(line: str) -> list[str]:
    return line.strip("\x0c\r").split()


def core(token: str) -> str:
    """A word without signs around it, lower-cased; a noise sign at the end of a word is the word's."""
    token = token.strip(_STRIP)
    return token.rstrip(";").strip(_STRIP).lower()


def words_of(text: str, headers: set[str]) -> tuple[dict[int, str], list[tuple[int, int, int, str, str]]]:
    """Kinds of lines, and of the body all words in order: line, line of the second part or -1, length of the first part,
    the word, the hyphen between the parts. A word over two lines is one word."""
    lines, kinds = structure(text, headers)
    out: list[tuple[int, int, int, str, str]] = []
    held: tuple[int, str, str] | None = None
    for i, line in enumerate(lines):
        if i in kinds:
            continue
        parts = tokens(line)
        for k, token in enumerate(parts):
            if held:
                first, stem, sign = held
                held = None
                rest = core(token)
                out.append((first, i, len(stem), stem + rest, sign))
                continue
            if k == len(parts) - 1 and len(token) > 1 and token[-1] in HYPHENS:
                stem = token[:-1].lstrip(_STRIP).lower()
                if stem and any(c.isalpha() for c in stem):
                    held = (i, stem, token[-1])
                    continue
            if word := core(token):
                out.append((i, -1, len(word), word, ""))
    if held:
        out.append((held[0], -1, len(held[1]), held[1], ""))
    return kinds, out


def askable(word: str) -> bool:
    """Whether a token may be a word: it has a letter, and neither more letters nor more noise than words have."""
    return any(c.isalpha() for c in word) and len(word) <= LONGEST and sum(c in NOISE for c in word) <= NOISES


def candidates(word: str) -> dict[str, float]:
    """Words of which ``word`` may be a misreading, with the log probability of the confusions."""
    cyrillic, latin = sum(c in CYRILLIC for c in word), sum(c in LATIN for c in word)
    letters = CYRILLIC if cyrillic >= latin else LATIN
    out: dict[str, float] = {}
    base = {word: 0.0}
    if cyrillic and latin:  # letters of the other alphabet that look alike, all at once
        swap = {a: b for a, cs in CONFUSIONS.items() if len(a) == 1 for b, p in cs if p >= 0.01 and (b in letters) and (a not in letters) and a.isalpha()}
        base["".join(swap.get(c, c) for c in word)] = math.log(0.01)
    todo = [(w, p, 0, 0, 0) for w, p in base.items()]
    while todo:
        w, p, at, edits, replaced = todo.pop()
        if w != word and (w not in out or out[w] < p):
            out[w] = p
        if edits == EDITS:
            continue
        for i in range(at, len(w)):
            c = w[i]
            if c in NOISE:
                todo.append((w[:i] + w[i + 1 :], p + math.log(INSERTED), i, edits + 1, replaced))
                if replaced < REPLACEMENTS:
                    todo += [(w[:i] + x + w[i + 1 :], p + math.log(REPLACED), i + 1, edits + 1, replaced + 1) for x in letters]
            else:
                rest = [(w[:i] + b + w[i + 1 :], q, i + 1) for b, q in CONFUSIONS.get(c, ()) if q and (b in letters or b.isdigit())]
                rest += [(w[:i] + b + w[i + 2 :], q, i + 1) for b, q in CONFUSIONS.get(w[i : i + 2], ()) if b in letters]
                todo += [(x, p + math.log(q), j, edits + 1, replaced) for x, q, j in rest]
    return out


def word_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, b, n`` of neighbouring words of all texts, and ``word, in_texts, in_scans`` of all words."""
    split = lambda c: F.filter(F.split(F.lower(c), "[^\\p{L}\\p{N}’\\-]+"), lambda w: w != "")
    texts = docs.where("text is not null").select(split("text").alias("w")).where(F.size("w") > 0)
    pairs = texts.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"))).alias("p"))
    pairs = cut(pairs.select("p.a", F.coalesce("p.b", F.lit("")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    # equal scans count once: copies would make their misread words usual
    scans = once(docs.where("extracted_text is not null").select("extracted_text", F.xxhash64("extracted_text").alias("hash")), "hash")
    scans = scans.select(F.explode(split("extracted_text")).alias("word"))
    both = pairs.groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("in_texts"), F.lit(0).cast("long").alias("in_scans")).unionByName(
        scans.groupBy("word").agg(F.lit(0).cast("long").alias("in_texts"), F.count(F.lit(1)).alias("in_scans"))
    )
    return pairs, cut(both.groupBy("word").agg(F.sum("in_texts").alias("in_texts"), F.sum("in_scans").alias("in_scans")))


def _most_frequent(counts: DataFrame) -> dict[str, int]:
    """The words that texts have most often, at most FREQUENT, with their counts; the least count that is let in is read
    off the numbers of words by count."""
    known = counts.where(F.col("in_texts") >= KNOWN)
    upto = F.sum("of").over(Window.orderBy(F.desc("in_texts")))
    by_count = known.groupBy("in_texts").agg(F.count(F.lit(1)).alias("of"))
    least = by_count.withColumn("upto", upto).where(F.col("upto") <= FREQUENT).agg(F.min("in_texts").alias("n")).head()["n"]
    return {r["word"]: r["in_texts"] for r in known.where(F.col("in_texts") >= least).select("word", "in_texts").collect()} if least else {}


def head_forms(text: str) -> list[tuple[str, int, int]]:
    """Of each head form of a text: whether a line of it comes back, and whether one does so at borders of pages often
    enough to be a running header by itself."""
    lines = text.split("\n")
    plain = [x.strip("\x0c\r \t") for x in lines]
    full = [i for i, x in enumerate(plain) if x]
    whole: dict[tuple[str, str], int] = {}
    borders: dict[tuple[str, str], int] = {}
    for at, i in enumerate(full):
        if not (key := head_form(lines[i])):
            continue
        own = key, form(_ALONE.match(lines[i].strip("\x0c\r ")).group(1))
        whole[own] = whole.get(own, 0) + 1
        before, after = full[at - 1] if at else -1, full[at + 1] if at + 1 < len(full) else len(lines)
        near = [plain[j] for j in (before, after) if 0 <= j < len(lines)]
        if (
            at in (0, len(full) - 1) or _NUMBERED.search(plain[i]) or any("\x0c" in x for x in lines[before + 1 : after + 1])
            or any(PAGE.match(x) or ROMAN.match(x) or BARE.match(x) for x in near)
        ):
            borders[own] = borders.get(own, 0) + 1
    again = {k for (k, _), n in whole.items() if n > 1}
    alone = {k for (k, _), n in borders.items() if n >= HEADER_TIMES}
    return [(k, int(k in again), int(k in alone)) for k in dict.fromkeys(k for k, _ in whole)]


def _head_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = [(i, *x) for i, text in zip(pdf["doc_id"], pdf["extracted_text"]) for x in head_forms(text)]
        yield pd.DataFrame(out, columns=["doc_id", "head", "again", "alone"])


def headers(scans: DataFrame) -> DataFrame:
    """``doc_id, heads``: of each document the forms that are running headers, by the document itself or over all."""
    forms = cut(scans.mapInPandas(_head_forms, "doc_id long, head string, again int, alone int"))
    often = forms.groupBy("head").agg(F.count(F.lit(1)).alias("docs"), F.sum("again").alias("again"))
    often = often.where((F.col("docs") >= HEADER_DOCUMENTS) & (F.col("again") >= HEADER_SHARE * F.col("docs"))).select("head")
    heads = forms.where("alone = 0").join(often, "head").select("doc_id", "head").unionByName(forms.where("alone = 1").select("doc_id", "head"))
    return heads.groupBy("doc_id").agg(F.collect_set("head").alias("heads"))


ASK = "doc_id long, line int, line2 int, cut int, place int, word string, sign string, before string, after string, after_n long, kind string"


def _asks(frequent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frequent.value
        rare = min(known.values(), default=1)
        names = [c.split()[0] for c in ASK.split(", ")]
        for pdf in batches:
            out = []
            for i, text, heads in zip(pdf["doc_id"], pdf["extracted_text"], pdf["heads"]):
                kinds, words = words_of(text, set() if heads is None else set(heads))
                out += [(i, n, -1, 0, -1, "", "", "", "", 0, kind) for n, kind in kinds.items()]
                for k, (line, line2, at, word, sign) in enumerate(words):
                    before, after = words[k - 1][3] if k else "", words[k + 1][3] if k + 1 < len(words) else ""
                    if sign:
                        # whether the hyphen is the word's own is asked with the word that has it
                        out.append((i, line, line2, at, k, word[:at] + "-" + word[at:], sign, before, after, 0, "own"))
                    if (sign or word not in known) and askable(word):
                        out.append((i, line, line2, at, k, word, sign, before, after, known.get(after, rare), "word"))
            yield pd.DataFrame(out, columns=names)

    return run


def _candidates(words):
    """Each word with its candidates, itself among them; of those only words, where the hashes of all words are known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = words.value
        for pdf in batches:
            out = []
            for w in pdf["word"]:
                out.append((w, w, 0.0))
                out += [(w, c, p) for c, p in candidates(w).items()]
            found = pd.DataFrame(out, columns=["word", "candidate", "channel"])
            if hashes is not None and len(found):
                own = np.fromiter((xxhash.xxh64_intdigest(c.encode(), 42) for c in found["candidate"]), np.uint64, len(found)).view(np.int64)
                at = np.searchsorted(hashes, own)
                found = found[(at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == own) | (found["word"] == found["candidate"])] if len(hashes) else found[found["word"] == found["candidate"]]
            yield found

    return run


def _viterbi(options: list[list[tuple[str, float, float, float]]], pairs: dict[tuple[str, str], int], total: float) -> list[str]:
    """The most likely word for each place. A candidate: the word, log probability of its confusions, how often it occurs,
    and how often other words follow it.

    The probability of a word after another is the share of such pairs, mixed with the word's own share as if BACKOFF
    pairs more had been seen.
    """

    def after(x: tuple, y: tuple) -> float:
        return math.log((pairs.get((x[0], y[0]), 0) + BACKOFF * y[2] / total) / (x[3] + BACKOFF))

    best = [(o[1], o, [o[0]]) for o in options[0]]
    for here in options[1:]:
        step = []
        for o in here:
            score, path = max(((s + after(last, o), path) for s, last, path in best), key=lambda x: x[0])
            step.append((score + o[1], o, [*path, o[0]]))
        best = step
    return max(best, key=lambda x: x[0])[2]


def _decode(total: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lattices of runs of neighbouring unknown words, each between two known ones, to the words chosen."""
        for pdf in batches:
            out = []
            for i, rows, pairs in zip(pdf["doc_id"], pdf["rows"], pdf["pairs"]):
                seen = {(r["a"], r["b"]): r["n"] for r in pairs} if pairs is not None else {}
                rows = sorted(rows, key=lambda r: r["place"])
                run: list = []
                for k, r in enumerate(rows):
                    run.append(r)
                    if k + 1 < len(rows) and rows[k + 1]["place"] == r["place"] + 1:
                        continue
                    places = [[(o["candidate"], o["channel"], o["total"], o["texts"]) for o in x["options"]] for x in run]
                    # how often the word before occurs is the same for all that may follow it
                    lattice = [[(run[0]["before"], 0.0, 1.0, 0.0)], *places, [(run[-1]["after"], 0.0, max(run[-1]["after_n"], 1), 0.0)]]
                    out += [(i, x["place"], w) for x, w in zip(run, _viterbi(lattice, seen, total)[1:-1])]
                    run = []
            yield pd.DataFrame(out, columns=["doc_id", "place", "chosen"])

    return run


def _pairs_asked(rows: str) -> Column:
    """The pairs ``a, b`` that the lattice of a document asks for: candidates of neighbouring places, and at both ends of a
    run of them the known words there."""

    def of(x: Column, i: Column) -> Column:
        last, following = F.get(rows, i - 1), F.get(rows, i + 1)
        here = x["options"]["candidate"]
        before = F.when(F.coalesce(last["place"] == x["place"] - 1, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(x["before"]))
        after = F.when(following["place"] == x["place"] + 1, following["options"]["candidate"]).otherwise(F.array(x["after"]))
        return F.concat(_cross(before, here), _cross(here, after))

    return F.flatten(F.transform(rows, of))


def _cross(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(x.alias("a"), y.alias("b")))))


def corrections(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kinds of lines ``doc_id, line, kind``, and of each word that is over two lines or unknown what it should be:
    ``doc_id, line, line2, cut, place, word, sign, chosen, own``."""
    scans = docs.where("extracted_text is not null").select(F.col("doc_id").cast("long"), "extracted_text").dropDuplicates(["doc_id"])
    pairs, counts = word_counts(docs)
    total = F.col("in_texts") + F.col("in_scans")
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(_most_frequent(counts))
    numbers = counts.agg(F.sum(total).alias("words"), F.sum((total >= 2).cast("long")).alias("of")).head()
    hashes = None
    if (numbers["of"] or 0) <= HASHES:
        found = counts.where(total >= 2).select(F.xxhash64("word").alias("h")).toPandas()["h"]
        hashes = np.sort(found.to_numpy(np.int64))
    words = spark.sparkContext.broadcast(hashes)
    asks = cut(scans.join(headers(scans), "doc_id", "left").select("doc_id", "extracted_text", "heads").mapInPandas(_asks(frequent), ASK))
    kinds = asks.where("kind in ('header', 'page_number')").select("doc_id", "line", "kind")
    asked = cut(asks.where("kind = 'word'").select("word").distinct())
    # few bytes, but much work for each row: parts by the number of rows, which no size of them merges
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count() // ASKED_PER_TASK)
    found = (
        asked.repartition(parts, "word").mapInPandas(_candidates(words), "word string, candidate string, channel double")
        .join(counts.where(total >= 2).select(F.col("word").alias("candidate"), "in_texts", total.alias("total")), "candidate")
    )
    best = found.groupBy("word").agg(
        F.max(F.when(F.col("word") == F.col("candidate"), F.col("in_texts"))).alias("texts"),
        F.max(F.when(F.col("word") == F.col("candidate"), F.col("total"))).alias("own"),
        F.max(F.when(F.col("word") != F.col("candidate"), F.col("total"))).alias("other"),
        F.sort_array(F.collect_list(F.struct("channel", "candidate", F.col("total").cast("double").alias("total"), F.col("in_texts").cast("double").alias("texts"))), asc=False).alias("options"),
    )
    plain = ~F.col("word").rlike("[0-9~^*|;¦`#_]")
    mixed = F.col("word").rlike("[a-z]") & F.col("word").rlike("[а-яё]")
    own, other = F.coalesce("own", F.lit(0)), F.coalesce("other", F.lit(0))
    known = (F.coalesce("texts", F.lit(0)) >= KNOWN) & ~mixed | plain & ~mixed & (own >= KNOWN_IN_SCANS) & (other < COMMONER * own)
    unseen = F.when(plain & ~mixed, UNSEEN).otherwise(UNSEEN_MIXED)
    as_read = F.struct(F.lit(0.0).alias("channel"), F.col("word").alias("candidate"), unseen.alias("total"), F.lit(0.0).alias("texts"))
    options = F.when(~known, F.concat(F.array(as_read), F.filter("options", lambda o: o["candidate"] != F.col("word"))))
    best = best.select("word", options.alias("options")).where(F.size("options") > 1)
    lattice = asks.where("kind = 'word'").join(best, "word")
    rows = lattice.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "before", "after", "after_n", "options"))).alias("rows"))
    # pairs are looked up only where a place has a choice
    wanted = rows.select("doc_id", F.explode(_pairs_asked("rows")).alias("p")).select("doc_id", "p.*").distinct()
    likely = wanted.join(pairs, ["a", "b"]).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "n")).alias("pairs"))
    chosen = rows.join(likely, "doc_id", "left").mapInPandas(_decode(float(numbers["words"] or 1)), "doc_id long, place int, chosen string")
    owned = (
        asks.where("kind = 'own'").select("doc_id", "place", "word").join(counts, "word").groupBy("doc_id", "place").agg(F.max(total).alias("own"))
    )
    joined = asks.where("kind = 'word' and sign <> ''").select("doc_id", "place", "word").join(counts, "word").groupBy("doc_id", "place").agg(F.max(total).alias("whole"))
    words = asks.where("kind = 'word'").drop("kind", "before", "after").join(chosen, ["doc_id", "place"], "left").join(owned, ["doc_id", "place"], "left").join(joined, ["doc_id", "place"], "left")
    return kinds, words


def _first_difference(word: str, chosen: str) -> int:
    n = min(len(word), len(chosen))
    return next((i for i in range(n) if word[i] != chosen[i]), n)


def found_noise(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, kind``: running headers, page numbers, lines ending in a hyphen that isn't the word's own, and
    body lines with a misread character.

    Documents without a scanned text, or with an empty one, have no rows. Repeated rows count once.
    """
    kinds, words = corrections(docs)
    misread = F.col("chosen").isNotNull() & (F.col("chosen") != F.col("word"))
    hyphen = words.where("sign <> ''").where(_is_broken()).select("doc_id", F.col("line").alias("line_no"), F.lit("hyphen").alias("kind"))
    # a word over two lines is misread in the line where it first differs, and in the second if the rest does too
    n = F.length("word")
    tail = F.col("word").substr(F.col("cut") + 1, n) != F.col("chosen").substr(F.length("chosen") - (n - F.col("cut")) + 1, n)
    head = F.col("word").substr(F.lit(1), F.col("cut")) != F.col("chosen").substr(F.lit(1), F.col("cut"))
    first = words.where(misread & ((F.col("line2") < 0) | head)).select("doc_id", F.col("line").alias("line_no"), F.lit("misread").alias("kind"))
    second = words.where(misread & (F.col("line2") >= 0) & tail).select("doc_id", F.col("line2").alias("line_no"), F.lit("misread").alias("kind"))
    return kinds.select("doc_id", F.col("line").alias("line_no"), "kind").unionByName(hyphen).unionByName(first).unionByName(second).distinct()


def _is_broken():
    """Whether the hyphen of a word over two lines was put there by the line break: not if the word with it is more frequent."""
    own, whole = F.coalesce("own", F.lit(0)), F.coalesce("whole", F.lit(0))
    restored = F.when(F.col("chosen").isNotNull() & (F.col("chosen") != F.col("word")), F.lit(1)).otherwise(0)
    return (whole + restored >= own) | (own == 0)


def _repair_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, text, marks, fixes, heads in zip(pdf["doc_id"], pdf["extracted_text"], pdf["marks"], pdf["fixes"], pdf["heads"]):
            drop = set() if marks is None else set(marks)
            fixed = {} if fixes is None else {f["place"]: f for f in fixes}
            paragraphs, words, place = [], [], -1
            held = None
            for n, line in enumerate(text.split("\n")):
                if n in drop:
                    continue
                parts = tokens(line)
                if not parts and words and not held:
                    paragraphs.append(" ".join(words))
                    words = []
                for k, token in enumerate(parts):
                    if held is not None:
                        token, held, joined = held + token, None, True
                    else:
                        joined = False
                    if not joined and k == len(parts) - 1 and len(token) > 1 and token[-1] in HYPHENS and any(c.isalpha() for c in token[:-1]):
                        nxt = fixed.get(place + 1)
                        held = token[:-1] + ("" if nxt is None or nxt["broken"] else "-")
                        continue
                    if not core(token):
                        words.append(token)
                        continue
                    place += 1
                    f = fixed.get(place)
                    if f is not None and f["chosen"] and f["chosen"] != f["word"]:
                        word, low = f["chosen"], token.lower()
                        at = low.find(f["word"])
                        if at >= 0:
                            was = token[at : at + len(f["word"])]
                            word = word.upper() if was.isupper() and len(was) > 1 else word.capitalize() if was[:1].isupper() else word
                            token = token[:at] + word + token[at + len(f["word"]) :]
                    words.append(token)
            if held:
                words.append(held)
            if words:
                paragraphs.append(" ".join(words))
            out.append((i, "\n\n".join(paragraphs)))
        yield pd.DataFrame(out, columns=["doc_id", "repaired"])


def repaired_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, repaired``: each scanned text as continuous paragraphs, without headers and page numbers, words over two
    lines joined, misread words corrected. An empty text stays empty."""
    kinds, words = corrections(docs)
    marks = kinds.groupBy("doc_id").agg(F.collect_set("line").alias("marks"))
    fixes = words.groupBy("doc_id").agg(F.collect_list(F.struct("place", "word", "chosen", _is_broken().alias("broken"))).alias("fixes"))
    scans = docs.where("extracted_text is not null").select(F.col("doc_id").cast("long"), "extracted_text").dropDuplicates(["doc_id"])
    rows = scans.join(marks, "doc_id", "left").join(fixes, "doc_id", "left").withColumn("heads", F.lit(None).cast("string"))
    return rows.select("doc_id", "extracted_text", "marks", "fixes", "heads").mapInPandas(_repair_text, "doc_id long, repaired string")
