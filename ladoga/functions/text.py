"""Text expressions. All are built-in column expressions, so they stay inside generated code and are pushed with the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words when a question or a text is brought to its normal form.
SEPARATORS = "[.,!?:;()\\-–—/\"'«»\\s]+"
WORD = "[\\p{L}\\p{N}]+"
CODE = "(?<![\\d.])\\d{2}\\.\\d{2}\\.\\d{2}(?![\\d.])"
YEARS = "20\\d{2}[/-]20\\d{2}"
DAY = "(?<!\\d)\\d{1,2}\\.\\d{1,2}\\.20\\d{2}(?!\\d)"
MONEY = "\\d{1,3}(?: \\d{3})+(?= руб)"
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
PHONE = "(?:\\+7|8)?[ -]?\\(?\\d{3}\\)?[ -]?\\d{3}[ -]?\\d{2}[ -]?\\d{2}(?!\\d)"

STOP = ["для", "как", "что", "это", "или", "при", "над", "под", "the", "and", "for", "how", "what", "der", "die", "das", "und"]
#: Endings cut from the end of words, longest first.
SUFFIXES = ["ями", "ами", "ого", "его", "ому", "ему", "ыми", "ими", "ая", "яя", "ое", "ее", "ые", "ие", "ой", "ей", "ый", "ий", "ом", "ем", "ую", "юю", "ам", "ям", "ах", "ях", "ов", "ев", "а", "я", "о", "е", "ы", "и", "у", "ю", "ь"]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(c: str | Column) -> Column:
    """Lower-cased with ё made е."""
    return F.replace(F.lower(_c(c)), F.lit("ё"), F.lit("е"))


def normalize(c: str | Column) -> Column:
    """Folded, separators made single blanks, trimmed."""
    return F.trim(F.regexp_replace(folded(c), SEPARATORS, " "))


def tokens(c: str | Column) -> Column:
    """The words of the normal form, in order."""
    return F.filter(F.split(normalize(c), " "), lambda w: w != "")


def index_tokens(c: str | Column) -> Column:
    """Runs of letters and digits of the lower-cased text, in order: the words of the lexical index."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(WORD), F.lit(0))


def stem(word: Column) -> Column:
    """A word without its longest known ending, if more than two letters are left."""
    return F.regexp_replace(word, f"^(.{{3,}}?)({'|'.join(SUFFIXES)})$", "$1")


def keywords(c: str | Column, least: int = 4) -> Column:
    """Blank-separated words of at least ``least`` bytes, case and signs kept."""
    return F.filter(F.split(_c(c), "[ \\t\\n\\r]+"), lambda w: F.octet_length(w) >= least)


def question_terms(c: str | Column) -> Column:
    """Distinct normal words of at least three letters that are no stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda w: (F.length(w) >= 3) & ~w.isin(STOP)))


def compound_parts(c: str | Column, least: int = 10) -> Column:
    """The parts of a compound question of more than ``least`` characters; the whole if there are none."""
    parts = F.filter(F.transform(F.split(_c(c), " и |, |; "), lambda p: F.trim(p)), lambda p: F.length(p) > least)
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(F.trim(_c(c))))


def sentences(c: str | Column) -> Column:
    """Split after ``! ? ;`` or a full stop that follows no digit, before a blank."""
    marked = F.regexp_replace(_c(c), "([!?;]|[^0-9][.])[ \\t]+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "[\u0001\\n]"), lambda s: F.trim(s)), lambda s: s != "")


def found(c: str | Column, pattern: str) -> Column:
    """All matches of ``pattern``, in order."""
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(0))


def phone_digits(phone: Column) -> Column:
    """Digits of a phone number without the country's 7 or 8."""
    digits = F.regexp_replace(phone, "[^0-9]", "")
    return F.when((F.length(digits) == 11) & F.substring(digits, 1, 1).isin("7", "8"), F.substring(digits, 2, 10)).otherwise(digits)


def proper_nouns(c: str | Column) -> Column:
    """Capitalised words that don't begin the text, distinct, in order."""
    return F.array_distinct(found(F.regexp_replace(_c(c), "^\\s*\\S+", ""), "(?<![\\p{L}\\p{N}])\\p{Lu}\\p{Ll}+"))


def content_hash(c: str | Column) -> Column:
    return F.sha2(_c(c), 256)


def url_id(c: str | Column) -> Column:
    """The first 16 hexadecimal digits of the address's hash."""
    return F.substring(F.sha2(_c(c), 256), 1, 16)


def title_from_url(c: str | Column) -> Column:
    """The last part of the path, hyphens made blanks, without a trailing number."""
    last = F.regexp_extract(_c(c), "([^/]+)/*$", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(last, "-?[0-9]*$", ""), "[-_]+", " "))


def address(c: str | Column) -> Column:
    """A web address without fragment and slashes at its end, host lower-cased, over https."""
    host, rest = F.lower(F.regexp_extract(_c(c), "^(https?://[^/?#]+)", 1)), F.regexp_extract(_c(c), "^https?://[^/?#]+([^#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.concat(host, rest), "/+$", ""), "^http:", "https:")


def absolute(href: str | Column, base: str | Column) -> Column:
    """A link as a whole address, without fragment and slashes at its end, read against the address of its page."""
    h, url = _c(href), _c(base)
    site = F.regexp_extract(url, "^(https?://[^/?#]+)", 1)
    whole = (
        F.when(h.rlike("^https?://"), h).when(F.startswith(h, F.lit("//")), F.concat(F.lit("https:"), h)).when(F.startswith(h, F.lit("/")), F.concat(site, h))
        .when((h == "") | F.startswith(h, F.lit("#")), url).otherwise(F.concat(F.regexp_replace(url, "[^/]*$", ""), h))
    )
    return F.regexp_replace(F.regexp_replace(whole, "#.*$", ""), "/+$", "")


def unescaped(c: str | Column) -> Column:
    """The common entities of HTML resolved, the ampersand last."""
    c = _c(c)
    for entity, sign in (("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return c


def without_phrases(c: str | Column, pattern: str) -> Column:
    """Without the phrases of ``(before)(phrase)(after)``, twice, as neighbouring ones share a blank; blanks made one."""
    out = F.regexp_replace(F.regexp_replace(_c(c), pattern, "$1$3"), pattern, "$1$3")
    return F.trim(F.regexp_replace(out, " +", " "))


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text contains any of the words."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def byte_prefix(c: Column, n: int) -> Column:
    """The first ``n`` bytes."""
    return F.substring(c.cast("binary"), 1, n)
