"""Queries that prepare questions and judge texts by rules: cleanup, synonyms, relevance, records, links, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladoga.functions import text as T
from ladoga.operators import changes, chunking, rescoring, understanding
from ladoga.plans.corpus import ASKED, NORM, PAGES, QTERMS, TERMS, pages, questions
from ladoga.plans.dialogs import SYNONYMS, turns
from ladoga.plans.registry import registry
from ladoga.plans.retrieval import BM25, Q, _ranked, asked
from ladoga.plans.state import F_
from ladoga.workspace import table

QUERIES, SQL, query = registry()

_POLITE = "(?:^| )(?:здравствуйте|добрый день|привет|подскажите|скажите|пожалуйста|hello|please|guten tag|bitte)(?= |$)"
_POLITE_RE2 = "(^| )(здравствуйте|добрый день|привет|подскажите|скажите|пожалуйста|hello|please|guten tag|bitte)( |$)"
_TWICE = "regexp_replace(regexp_replace({0}, '" + _POLITE_RE2 + "', '\\1\\3', 'g'), '" + _POLITE_RE2 + "', '\\1\\3', 'g')"


@query(
    f"""WITH a AS (SELECT id, regexp_replace(regexp_replace(text, '&[a-z#0-9]+;', ' ', 'g'), '[^\\p{{L}}\\p{{N}} .-]+', ' ', 'g') AS t FROM {ASKED}),
    b AS (SELECT id, {NORM.format('t')} AS t FROM a)
    SELECT id, trim(regexp_replace({_TWICE.format('t')}, ' +', ' ', 'g'), ' ') AS cleaned FROM b"""
)
def cleaned_question(spark: SparkSession, d: str) -> DataFrame:
    """Questions without entities, signs and words of politeness, in their normal form."""
    t = F.regexp_replace(F.regexp_replace("text", "&[a-z#0-9]+;", " "), "[^\\p{L}\\p{N} .-]+", " ")
    q = questions(spark, d).select("id", T.normalize(t).alias("t"))
    return q.select("id", T.without_phrases("t", _POLITE_RE2).alias("cleaned"))


_CASES = "coalesce(" + ", ".join(f"CASE WHEN contains({NORM.format('text')}, '{a}') THEN replace({NORM.format('text')}, '{a}', '{b}') END" for a, b in SYNONYMS) + ")"
_ANY = " || ".join(f"CASE WHEN contains({NORM.format('text')}, '{a}') THEN ' OR {b}' ELSE '' END" for a, b in SYNONYMS)


@query(
    f"""SELECT id, {_CASES} AS replaced, {NORM.format('text')} || {_ANY} AS any_of,
    list_sort(list_distinct(list_filter([{', '.join(f"CASE WHEN len(list_filter({TERMS.format('text')}, lambda w: starts_with(w, '{a[:4]}'))) > 0 THEN '{b}' END" for a, b in SYNONYMS)}], lambda x: x IS NOT NULL))) AS by_prefix FROM {ASKED}"""
)
def synonym_forms(spark: SparkSession, d: str) -> DataFrame:
    """Three more forms of a question by synonyms: one word replaced, alternatives joined with OR, words found by prefix."""
    norm, words = T.normalize("text"), T.tokens("text")
    replaced = F.coalesce(*[F.when(F.contains(norm, F.lit(a)), F.replace(norm, F.lit(a), F.lit(b))) for a, b in SYNONYMS])
    any_of = F.concat(norm, *[F.when(F.contains(norm, F.lit(a)), F.lit(f" OR {b}")).otherwise("") for a, b in SYNONYMS])

    def begins(a: str):
        return F.exists(words, lambda w: F.startswith(w, F.lit(a[:4])))

    each = F.array(*[F.when(begins(a), F.lit(b)) for a, b in SYNONYMS])
    return questions(spark, d).select("id", replaced.alias("replaced"), any_of.alias("any_of"), F.array_sort(F.array_distinct(F.filter(each, lambda x: x.isNotNull()))).alias("by_prefix"))


_STEM = "regexp_replace({0}, '^(.{{3,}}?)(" + "|".join(T.SUFFIXES) + ")$', '\\1')"


@query(
    f"""WITH {BM25}, c AS (SELECT b.query_id, b.id, {QTERMS.format('qq.text')} AS terms, {NORM.format('f.text')} AS norm, qq.text AS question, f.text AS body
      FROM (SELECT * FROM bmr WHERE rank <= 10) b JOIN {Q} qq USING (query_id) JOIN (SELECT DISTINCT id, text FROM fragments) f USING (id)),
    m AS (SELECT *, len(list_filter(terms, lambda w: contains(norm, {_STEM.format('w')})))::DOUBLE AS hit, len(terms)::DOUBLE AS n,
      len(list_filter(list_distinct(regexp_extract_all(question, '[0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}}')), lambda e: contains(body, e))) AS named FROM c)
    SELECT query_id, id, hit::INT AS hit, round(0.25 * hit + CASE WHEN n >= 3 AND hit = n THEN 0.5 ELSE 0 END + CASE WHEN n > 0 AND hit / n >= 0.5 THEN 0.3 * hit / n ELSE 0 END + 0.3 * named, 6)::DOUBLE AS relevance FROM m"""
)
def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Candidates scored by rules: each term by its stem, all of them, their share, and codes of the question."""
    texts = table(spark, d, "fragments", "id", "text").dropDuplicates(["id"]).withColumnRenamed("text", "body")
    c = _ranked(spark, d).select("query_id", "id").join(asked(spark, d).withColumnRenamed("text", "question"), "query_id").join(texts, "id")
    return rescoring.by_keywords(c).select("query_id", "id", "hit", "relevance")


LINK = "regexp_extract({0}, '^(https?://[^/?#]+)', 1)"


@query(
    f"""WITH h AS (SELECT id, url, unnest(regexp_extract_all(raw_html, 'href="([^"]*)"', 1)) AS href FROM {PAGES})
    SELECT link, count(*) AS n, count(DISTINCT id) AS pages FROM (SELECT id, rtrim(regexp_replace(CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '//') THEN 'https:' || href
      WHEN starts_with(href, '/') THEN {LINK.format('url')} || href WHEN href = '' OR starts_with(href, '#') THEN url ELSE regexp_replace(url, '[^/]*$', '') || href END, '#.*$', ''), '/') AS link FROM h) GROUP BY 1"""
)
def absolute_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages as whole addresses, without fragments and slashes at the end."""
    links = pages(spark, d, "url", "raw_html").select("id", "url", F.explode(F.regexp_extract_all("raw_html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.select("id", T.absolute("href", "url").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("pages"))


@query(
    f"""WITH n AS (SELECT id, url_stable, text_hash, version_number AS version, lead(text_hash) OVER w AS next, lead(created_at) OVER w AS replaced_at FROM {F_} WINDOW w AS (PARTITION BY url_stable ORDER BY created_at, id))
    SELECT id, url_stable, text_hash, version, replaced_at FROM n WHERE next <> text_hash"""
)
def history_rows(spark: SparkSession, d: str) -> DataFrame:
    """What goes to the history when a fragment is replaced: its old content with its version."""
    f = table(spark, d, "fragments", "id", "url_stable", "text_hash", "version_number", "created_at").where("url_stable is not null").dropDuplicates(["id"])
    return changes.replaced(f.withColumnRenamed("version_number", "version"), "url_stable", "created_at", "text_hash").select("id", "url_stable", "text_hash", "version", "replaced_at")


@query(
    """WITH f AS (SELECT DISTINCT id, page_id, content_type, section_title FROM fragments)
    SELECT id, content_type FROM f WHERE NOT (coalesce(section_title, '') LIKE '%кабинет%' OR coalesce(section_title, '') LIKE '%отдел%')
    UNION ALL SELECT f.id, 'moved' FROM f JOIN (SELECT DISTINCT id, specialty_code FROM pages WHERE specialty_code IS NOT NULL) p ON p.id = f.page_id WHERE section_title LIKE '%кабинет%' OR section_title LIKE '%отдел%'"""
)
def purge_and_copy(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose title is like given ones deleted, and those of pages with a specialty inserted again under another type."""
    f = table(spark, d, "fragments", "id", "page_id", "content_type", "section_title").dropDuplicates(["id"])
    like = F.coalesce(F.col("section_title").like("%кабинет%") | F.col("section_title").like("%отдел%"), F.lit(False))
    p = pages(spark, d, "specialty_code").where("specialty_code is not null").select(F.col("id").alias("page_id"))
    moved = f.where(like).join(p, "page_id").select("id", F.lit("moved").alias("content_type"))
    return f.where(~like).select("id", "content_type").unionByName(moved)


_CODES = "regexp_extract_all(user_message, '[0-9]{2}\\.[0-9]{2}\\.[0-9]{2}')"


@query(
    f"""WITH e AS (SELECT DISTINCT turn_id, session_id, turn_ts, {_CODES} AS codes FROM dialog_turns WHERE session_id IS NOT NULL),
    l AS (SELECT turn_id, codes, [lag(codes, 5) OVER w, lag(codes, 4) OVER w, lag(codes, 3) OVER w, lag(codes, 2) OVER w, lag(codes, 1) OVER w] AS p FROM e WINDOW w AS (PARTITION BY session_id ORDER BY turn_ts, turn_id)),
    a AS (SELECT turn_id, list_reverse(flatten(list_filter(list_append(p, codes), lambda x: x IS NOT NULL))) AS c FROM l)
    SELECT turn_id, list_filter(c, lambda x, i: list_position(c, x) = i)[:5] AS entities FROM a"""
)
def turn_entities(spark: SparkSession, d: str) -> DataFrame:
    """The specialties a dialog is about when a turn ends: the latest five named in it and the five turns before."""
    t = turns(spark, d).withColumn("codes", F.regexp_extract_all("user_message", F.lit("[0-9]{2}\\.[0-9]{2}\\.[0-9]{2}"), F.lit(0)))
    w = understanding.with_previous(t, "session_id", "turn_ts", "turn_id", 5, F.col("codes"))
    both = F.filter(F.concat("previous", F.array("codes")), lambda x: x.isNotNull())
    return w.select("turn_id", F.slice(F.array_distinct(F.reverse(F.flatten(both))), 1, 5).alias("entities"))


@query(
    f"""WITH s AS (SELECT DISTINCT specialty_code AS code, unnest({QTERMS.format('specialty_name')}) AS term FROM pages WHERE specialty_code IS NOT NULL AND specialty_name IS NOT NULL),
    n AS (SELECT code, count(*) AS n FROM s GROUP BY 1), q AS (SELECT id, unnest({QTERMS.format('text')}) AS term FROM {ASKED})
    SELECT id, code FROM (SELECT id, code, count(*) AS m FROM q JOIN s USING (term) GROUP BY 1, 2) JOIN n USING (code) WHERE m = n"""
)
def specialty_named(spark: SparkSession, d: str) -> DataFrame:
    """Questions that have every word of a specialty's name; joined on the words, of which there are few."""
    s = table(spark, d, "pages", "specialty_code", "specialty_name").where("specialty_code is not null and specialty_name is not null").distinct()
    s = s.select(F.col("specialty_code").alias("code"), F.explode(T.question_terms("specialty_name")).alias("term")).distinct()
    n = s.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    q = questions(spark, d).select("id", F.explode(T.question_terms("text")).alias("term"))
    return q.join(s, "term").groupBy("id", "code").agg(F.count(F.lit(1)).alias("m")).join(n, "code").where("m = n").select("id", "code")


DATED = "^\\s*(Опубликовано |Дата обновления: |Last updated |)[0-9]{1,2}[./][0-9]{1,2}[./]20[0-9]{2}"


@query(
    f"""WITH l AS (SELECT id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS n FROM (SELECT id, string_split(text, chr(10)) AS x FROM {PAGES} WHERE text IS NOT NULL)),
    r AS (SELECT *, sum(regexp_matches(line, '{DATED}')::INT) OVER (PARTITION BY id ORDER BY n)::INT AS record FROM l)
    SELECT id, record, count(*)::INT AS lines, sha256(string_agg(line, chr(10) ORDER BY n)) AS hash FROM r WHERE record > 0 GROUP BY 1, 2"""
)
def dated_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The parts of pages that begin with a dated line."""
    p = pages(spark, d, "clean_text").withColumnRenamed("clean_text", "text")
    r = chunking.records(p, DATED).where("record > 0").groupBy("id", "record").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return r.select("id", "record", F.size("l").alias("lines"), T.content_hash(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("hash"))


_UNESCAPE = [("&nbsp;", " "), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")]


def _unescape_sql(x: str) -> str:
    for a, b in _UNESCAPE:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"SELECT id, {_unescape_sql('text')} AS plain FROM {ASKED} WHERE contains(text, '&')")
def unescaped(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the entities of HTML resolved."""
    return questions(spark, d).where(F.contains("text", F.lit("&"))).select("id", T.unescaped("text").alias("plain"))


@query("SELECT id, to_json(CAST(parent_titles::JSON AS VARCHAR[]))::VARCHAR AS encoded FROM (SELECT DISTINCT id, parent_titles FROM fragments WHERE parent_titles IS NOT NULL)")
def titles_encoded(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fragments", "id", "parent_titles").where("parent_titles is not null").dropDuplicates(["id"])
    return f.select("id", F.to_json(F.from_json("parent_titles", "array<string>")).alias("encoded"))


@query(f"SELECT id, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10) || chr(10))) AS hash FROM {PAGES} WHERE text IS NOT NULL")
def assembled_text(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of a page, trimmed, with an empty line between."""
    blocks = F.filter(F.transform(F.split("clean_text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages(spark, d, "clean_text").where("clean_text is not null").select("id", T.content_hash(F.array_join(blocks, "\n\n")).alias("hash"))
