"""Text that was decoded with the wrong character encoding.

Method: least description length. Words are counted over the whole corpus, and the most frequent ones of each language
become a zstandard dictionary. What a text costs is its compressed size under the dictionary that compresses it best. A
run of words takes the chain of wrong encodings whose undoing leaves the smallest size, the cost of the chain included;
where none is smaller than the run as it stands, it stays. Letters lost to substitution signs are one more chain: a
question mark may be a typed one, at no cost where sentences end and at some inside or before words, or stand for a lost
letter, which costs the word it was part of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladoga.workspace import cut, once

#: The dictionary of a language is a model of bounded size: its most frequent words. The counts cover all documents.
WORDS = 12_000
LEAST_COUNT = 3
LEVEL = 9
#: The frame of words in which sizes are taken: the longest of the most frequent.
FRAME_FROM, FRAME_WORDS = 200, 4
#: Bytes for a chain and for each step of it, and that a run must save beyond them.
CHAIN_BYTES = 1.0
STEP_BYTES = 1.0
LEAST_GAIN = 0.9
#: A step that is not through UTF-8 turns any letters into some letters, so there are many more of them to choose from.
GUESS_BYTES = 1.0
#: Bytes for a question mark where none is typed, and for the chain of lost letters.
MARK_BYTES = 2.0
LOST_BYTES = 3.0
DEPTH = 3
#: A chain that holds for more than this share of a text's words is applied to all of them.
WHOLE = 0.6
#: A word is taken for garbled when the dictionaries are made if one of its decodings is this many times as frequent.
COMMONER = 4

#: Signs around a word that are no part of it.
EDGE = ".,!?:;()\"'«»“”„-–—/ "
#: Those of them that no encoding garbles.
PLAIN_EDGE = ".,!?:;()\"'-/ "
OPENING = "«\"(„“'["

ENCODINGS = ("cp1251", "cp1252", "cp866", "koi8_r", "iso8859_5", "mac_cyrillic")
DECODINGS = ("utf_8", "cp1251", "koi8_r", "cp866", "cp1252", "iso8859_5", "mac_cyrillic")


def vocabulary(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``lang, word, n``: at most ``words`` most frequent words and signs of each language; a null language is one of its own.

    Equal texts count once: a garbled word of a text with many copies would look more usual than the word it was. The least count that is let in is read off the numbers of words by count, so no task ever sorts a language's words;
    of words that are equally frequent all are in or none.
    """
    lang = F.coalesce(F.lower("lang"), F.lit(""))
    texts = once(docs.where("text is not null").select(lang.alias("lang"), "text", F.xxhash64("text").alias("hash")), "lang", "hash")
    tokens = F.explode(F.split("text", "[ \\t\\r\\n0-9.,!?:;()/|]+"))
    counts = texts.select("lang", tokens.alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts.where(F.col("n") >= LEAST_COUNT))
    of_count = counts.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("of"))
    upto = F.sum("of").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    least = of_count.withColumn("upto", upto).where(F.col("upto") <= words).groupBy("lang").agg(F.min("n").alias("least")).collect()
    enough = F.lit(False)
    for r in least:  # one row a language
        enough = enough | (F.col("lang") == r["lang"]) & (F.col("n") >= r["least"])
    return counts.where(enough)


def _plain(word: str) -> str:
    return word.strip(EDGE).lower() or word


def model(docs: DataFrame, words: int = WORDS) -> dict[str, list[str]]:
    """Per language its words, the rarest first; what reaches the driver is bounded by ``words`` for each language."""
    by_lang: dict[str, list[tuple[int, str]]] = {}
    counts: dict[str, int] = {}
    for r in vocabulary(docs, words).collect():
        by_lang.setdefault(r["lang"], []).append((r["n"], r["word"]))
        for form in {r["word"], r["word"].lower(), _plain(r["word"])}:
            counts[form] = counts.get(form, 0) + r["n"]

    def garbled(word: str, n: int) -> bool:
        """A garbled word may be frequent too, but what it is a garbled form of is more so; signs alone don't tell."""
        if word.isascii():
            return False
        for chain, text in decodings(word):
            other = max(counts.get(text, 0), counts.get(text.lower(), 0), counts.get(_plain(text), 0))
            letters = sum(map(str.isalpha, text))
            enough = other >= COMMONER * n if letters > 3 else word.isalpha() and text.isalpha() and other >= 8 * COMMONER * n
            if other and (enough or all(dec == "utf_8" for _, dec in chain)):
                return True
        return False

    return {lang: list(dict.fromkeys(_plain(w) for n, w in sorted(ws) if not garbled(w, n))) for lang, ws in sorted(by_lang.items())}


def _table(name: str) -> tuple[dict[int, int], dict[int, str]]:
    """Character to byte and back; bytes without a character stand for the control character of the same number."""
    back = {}
    for b in range(256):
        try:
            back[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            back[b] = chr(b)
    there = {ord(c): b for b, c in back.items()}
    if name == "cp1252":
        there |= {b: b for b in range(0x80, 0xA0)}
    return there, back


TABLES = {name: _table(name) for name in ENCODINGS}


def _bytes(text: str, name: str) -> bytes | None:
    there = TABLES[name][0]
    try:
        return bytes([there[ord(c)] for c in text])
    except KeyError:
        return None


def _text(data: bytes, name: str) -> str | None:
    if name == "utf_8":
        try:
            return data.decode("utf_8")
        except UnicodeDecodeError:
            return None
    back = TABLES[name][1]
    return "".join([back[b] for b in data])


def decodings(word: str) -> Iterator[tuple[tuple, str]]:
    """Every chain of wrong encodings that can be undone on ``word``, with the result; longer ones only through UTF-8."""
    todo = [((), word)]
    for chain, text in todo:
        for enc in ENCODINGS:
            data = _bytes(text, enc)
            if data is None or data.isascii():
                continue
            for dec in DECODINGS:
                if dec == enc or (result := _text(data, dec)) is None or result == text:
                    continue
                step = (*chain, (enc, dec))
                yield step, result
                if dec == "utf_8" and len(step) < DEPTH:
                    todo.append((step, result))


def chain_cost(chain: tuple) -> float:
    return CHAIN_BYTES + sum(STEP_BYTES + (dec != "utf_8") * GUESS_BYTES for _, dec in chain)


class Scorer:
    """Description lengths under the dictionaries of one model, and what each chain saves on a word."""

    def __init__(self, words: dict[str, list[str]]) -> None:
        self.known: set[str] = set().union(*words.values())
        self.letters: set[str] = set()
        self.languages = []
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.known):
            self.by_length.setdefault(len(w), []).append(w)
        for ws in words.values():
            self.letters |= {c for w in ws for c in w if c.isalpha()}
            # long words, which the dictionary shortens for certain: so close to raw a short text would be kept as it is
            self._add("\n".join(["", *ws, ""]), "\n".join(["", *sorted(ws[-FRAME_FROM:], key=len)[-FRAME_WORDS:], ""]))
        self.cache: dict[str, dict] = {}
        self.lost: dict[str, list[str]] = {}

    def _add(self, text: str, frame: str) -> None:
        """A compressor with a language's words; sizes are taken in a frame of words, beyond what the frame has by itself."""
        blob = text.encode("utf-8", "surrogatepass")
        data = zstandard.ZstdCompressionDict(blob, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=512, dict_size=len(blob), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        data.precompute_compress(compression_params=params)
        zstd = zstandard.ZstdCompressor(dict_data=data, compression_params=params)
        around = frame.encode("utf-8", "surrogatepass")
        self.languages.append((zstd.compress, around, len(zstd.compress(around + around[1:]))))

    def cost(self, text: str) -> float:
        """Bytes of a text under the dictionary that suits it best."""
        data = text.lower().encode("utf-8", "surrogatepass")
        return float(min([len(compress(around + data + around)) - own for compress, around, own in self.languages] or [len(data)]))

    def cost_of(self, tokens: list[str]) -> float:
        """Bytes of a run of words, each on a line as in the dictionaries."""
        return self.cost("\n".join([t.strip(PLAIN_EDGE) or t for t in tokens]))

    def chains(self, word: str) -> dict[tuple, tuple[float, str]]:
        """For each chain that can be undone on ``word``: bytes saved, without the cost of the chain, and the result.

        A result with signs that no text has, with letters of no language known, or with fewer letters, is none.
        """
        out: dict[tuple, tuple[float, str]] = {}
        own, letters, costs = self.cost_of([word]), sum(map(str.isalpha, word)), {}
        for chain, result in decodings(word):
            if any("\x7f" <= c < "\xa0" or "─" <= c <= "◿" or c == "�" for c in result) or not {c for c in result.lower() if c > "\x7f" and c.isalpha()} <= self.letters:
                continue
            # one or two signs alone are letters in any other encoding
            if any(dec != "utf_8" for _, dec in chain) and (letters == 0 and len(word.strip(PLAIN_EDGE)) < 3 or sum(map(str.isalpha, result)) < letters):
                continue
            if result not in costs:
                costs[result] = self.cost_of([result])
            out[chain] = (own - costs[result], result)
        return out

    def word(self, token: str) -> dict[tuple, tuple[float, str]]:
        if token.isascii():
            return {}
        if (found := self.cache.get(token)) is None:
            core = token.strip(EDGE + "\xa0").lower()
            # a word as the dictionaries have it is as short as can be
            found = {} if not core or core in self.known or core.isascii() and token.strip(EDGE).isascii() else self.chains(token)
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[token] = found
        return found

    def undone(self, word: str, chain: tuple) -> str:
        """``word`` after the chain, if that leaves letters that texts have and no word is lost by it; else as it is."""
        for c, result in decodings(word):
            if c == chain and {x for x in result.lower() if x > "\x7f" and x.isalpha()} <= self.letters:
                return result if _plain(result) in self.known or _plain(word) not in self.known else word
        return word

    def fitting(self, pattern: str) -> list[str]:
        """The words of the dictionaries that a word with lost letters (``?``) may have been."""
        if (out := self.lost.get(pattern)) is None:
            fits = re.compile("".join("[^\\W\\d_]" if c == "?" else re.escape(c) for c in pattern)).fullmatch
            out = [w for w in self.by_length.get(len(pattern), ()) if fits(w)]
            if len(self.lost) > 100_000:
                self.lost.clear()
            self.lost[pattern] = out
        return out


SPACES = re.compile("([ \t\n\r]+)")


def lost_letters(tokens: list[str], scorer: Scorer) -> tuple[bool, dict[int, str]]:
    """Whether question marks stand for lost letters, and by place the words that can only be one.

    Each word with marks costs its bytes and those of marks where none are typed: before and inside words, and alone or
    after an unknown word where the sentence goes on. Against that stand the bytes of the word it may have been.
    """
    gain, fixed = 0.0, {}
    for i, token in enumerate(tokens):
        if "?" not in token or any(c in token for c in "/=&"):
            continue
        body = token.lstrip(OPENING).rstrip(EDGE.replace("?", "")).lower()
        stem = body.rstrip("?")
        following = next((t.lstrip(OPENING) for t in tokens[i + 1 : i + 2]), "")
        goes_on = following[:1].islower() or following[:1].isdigit() or following[:1] == "?"
        if not stem:
            among = goes_on or i > 0 and not tokens[i - 1].strip(EDGE)
            marks = len(body) if among else 0
        else:
            marks = stem.count("?") + (len(body) - len(stem) if goes_on and stem.strip(EDGE) not in scorer.known else 0)
        if not marks:
            continue
        pattern = body if goes_on or not stem or stem == body else stem
        words = scorer.fitting(pattern) if stem else scorer.by_length.get(len(pattern), ())
        if words:
            saved = scorer.cost(body) + MARK_BYTES * marks - scorer.cost(words[0])
            if saved > 0:
                gain += saved
                if len(words) == 1 and stem:
                    fixed[i] = words[0]
    return (True, fixed) if gain - LOST_BYTES >= LEAST_GAIN else (False, {})


def _as_was(token: str, word: str) -> str:
    """``word`` in the place of the letters and marks of ``token``."""
    start = len(token) - len(token.lstrip(OPENING))
    was = token[start : start + len(word)]
    word = word.upper() if was.isupper() and sum(map(str.isalpha, was)) > 1 else word.capitalize() if was[:1].isupper() else word
    return token[:start] + word + token[start + len(word) :]


def _best_run(options: list[dict], tokens: list[str]) -> tuple[float, tuple | None, int, int]:
    """The run of words on which one chain saves most by the words' own sizes; a word between that it does not undo costs."""
    at: dict[tuple, list[tuple[int, float]]] = {}
    for i, o in enumerate(options):
        for chain, (gain, _) in o.items():
            at.setdefault(chain, []).append((i, gain))
    others, n = [], 0
    best: tuple[float, tuple | None, int, int] = (0.0, None, 0, 0)
    for chain, places in at.items():
        cost = chain_cost(chain)
        if sum(g for _, g in places if g > 0) - cost < LEAST_GAIN:
            continue
        if not others:
            for t in tokens:
                others.append(n)
                n += not t.isascii()
        gain, start, last = 0.0, 0, -1
        for i, g in places:
            if gain > 0:
                gain -= 2.0 * (others[i] - others[last] - 1)
            if gain <= 0:
                gain, start = 0.0, i
            gain, last = gain + g, i
            net = gain - cost
            if net > best[0] + 1e-9 or abs(net - best[0]) <= 1e-9 and best[1] and (len(chain), chain) < (len(best[1]), best[1]):
                best = (net, chain, start, i)
    return best


def repair(text: str, scorer: Scorer) -> tuple[bool, str, list[str]]:
    """Whether any part of the text was garbled, the text with what can be restored, and the chains used."""
    if text.isascii() and "?" not in text:
        return False, text, []
    parts = SPACES.split(text)
    tokens = parts[::2]
    options = [scorer.word(t) for t in tokens]
    found = "�" in text
    used: list[str] = []
    # best run of each chain, the one that saves most first, until none saves enough
    while any(options):
        net, chain, a, b = _best_run(options, tokens)
        if chain is None or net < LEAST_GAIN:
            break
        fits = lambda i: chain in options[i] or tokens[i].isascii()  # noqa: E731, B023
        while a > 0 and fits(a - 1):
            a -= 1
        while b + 1 < len(tokens) and fits(b + 1):
            b += 1
        run = [options[i][chain][1] if chain in options[i] else parts[2 * i] for i in range(a, b + 1)]
        # the run as a whole, in one piece, must be shorter too
        shorter = a == b or scorer.cost_of(parts[2 * a : 2 * b + 1 : 2]) - scorer.cost_of(run) - chain_cost(chain) >= LEAST_GAIN
        for i, word in zip(range(a, b + 1), run):
            if shorter:
                parts[2 * i], options[i] = word, {}
            else:
                options[i] = {c: x for c, x in options[i].items() if c != chain}
        if not shorter:
            continue
        found = True
        used.append("+".join(f"{e}>{d}" for e, d in chain))
        # where a chain holds for most of a text, the short words between are garbled too
        wide = [i for i, t in enumerate(tokens) if not t.isascii()]
        done = [i for i in wide if parts[2 * i] != tokens[i]]
        if len(done) > WHOLE * len(wide):
            for i in set(wide) - set(done):
                if (result := scorer.undone(tokens[i], chain)) != tokens[i]:
                    parts[2 * i], options[i] = result, {}
    if "?" in text or "�" in text:
        lost, fixed = lost_letters([t.replace("�", "?") for t in parts[::2]], scorer)
        if lost:
            found = True
            for i, word in fixed.items():
                parts[2 * i] = _as_was(parts[2 * i].replace("�", "?"), word)
            used += ["lost"] if fixed else []
    return found, "".join(parts), used


def _repairs(words: "object"):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(words.value)
        for pdf in batches:
            rows = [(False, None, []) if t is None else repair(t, scorer) for t in pdf["text"]]
            yield pd.DataFrame(
                {"tbl": pdf["tbl"], "rec_id": pdf["rec_id"], "garbled": [r[0] for r in rows], "restored": [r[1] for r in rows], "chains": [sorted(set(r[2])) for r in rows]}
            )

    return run


def corpus(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``lang, text``: the documents, and the texts themselves as a language of their own."""
    return docs.select("lang", "text").unionByName(texts.select(F.lit("").alias("lang"), "text"))


def restored(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``tbl, rec_id, text`` and the corpus ``lang, text`` to ``tbl, rec_id, garbled, restored, chains``.

    A null text stays null and an empty one empty, neither is garbled. Each text is worked on by itself.
    """
    words = texts.sparkSession.sparkContext.broadcast(model(corpus(texts, docs)))
    schema = "tbl string, rec_id long, garbled boolean, restored string, chains array<string>"
    return texts.select("tbl", F.col("rec_id").cast("long"), "text").mapInPandas(_repairs(words), schema)


def garbled_records(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """``tbl, rec_id, restored, chains`` of the affected records, each once."""
    return restored(texts, docs).where("garbled").drop("garbled").dropDuplicates(["tbl", "rec_id"])
