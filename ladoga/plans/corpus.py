"""Queries over pages, documents and questions as texts: scalars, chunks, links, claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladoga.functions import text as T
from ladoga.operators import chunking, grounding, rescoring, understanding
from ladoga.plans.registry import registry
from ladoga.sources import html
from ladoga.workspace import table

QUERIES, SQL, query = registry()

#: DuckDB's form of the normal form.
NORM = r"trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[.,!?:;()\-–—/\"''«»\s]+', ' ', 'g'), ' ')"
ASKED = "(SELECT DISTINCT request_id AS id, question AS text FROM chat_requests WHERE question IS NOT NULL)"
TERMS = "list_filter(string_split(" + NORM.format("{0}") + ", ' '), lambda w: w <> '')"
STOPS = "(" + ", ".join(f"'{w}'" for w in T.STOP) + ")"
QTERMS = "list_sort(list_distinct(list_filter(" + TERMS.format("{0}") + f", lambda w: length(w) >= 3 AND w NOT IN {STOPS})))"


FOLD = "replace(lower({0}), 'ё', 'е')"


def _hits(words: list[str], text: str) -> str:
    return "(" + " + ".join(f"contains({FOLD.format(text)}, '{w}')::INT" for w in words) + ")"


def _topic(text: str) -> str:
    each = {k: _hits(w, text) for k, w in understanding.TOPICS.items()}
    best = f"greatest({', '.join(each.values())})"
    return f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {h} = {best} THEN '{k}'" for k, h in each.items()) + " END"


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_requests", "request_id", "question").where("question is not null").select(F.col("request_id").alias("id"), F.col("question").alias("text")).dropDuplicates(["id"])


@query(f"SELECT id, {NORM.format('text')} AS norm FROM {ASKED}")
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", T.normalize("text").alias("norm"))


@query(f"SELECT id, {TERMS.format('text')} AS words FROM {ASKED}")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", T.tokens("text").alias("words"))


@query(f"SELECT w AS word, count(*) AS n, regexp_replace(w, '^(.{{3,}}?)({'|'.join(T.SUFFIXES)})$', '\\1') AS stem FROM (SELECT unnest({TERMS.format('text')}) AS w FROM {ASKED}) GROUP BY 1")
def stem_suffix(spark: SparkSession, d: str) -> DataFrame:
    words = questions(spark, d).select(F.explode(T.tokens("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.withColumn("stem", T.stem(F.col("word")))


@query(f"SELECT id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: strlen(w) >= 4) AS words FROM {ASKED}")
def keywords(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", T.keywords("text").alias("words"))


@query(f"SELECT id, {QTERMS.format('text')} AS terms FROM {ASKED}")
def question_terms(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", F.array_sort(T.question_terms("text")).alias("terms"))


@query(
    f"WITH p AS (SELECT id, text, list_filter(list_transform(regexp_split_to_array(text, ' и |, |; '), lambda p: trim(p, ' ')), lambda p: length(p) > 10) AS parts FROM {ASKED}) "
    "SELECT id, CASE WHEN len(parts) > 1 THEN parts ELSE [trim(text, ' ')] END AS parts FROM p"
)
def compound_split(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", T.compound_parts("text").alias("parts"))


@query(rf"SELECT id, list_sort(list_distinct(regexp_extract_all(regexp_replace(text, '^\s*\S+', ''), '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}}\p{{Ll}}+)', 2))) AS names FROM {ASKED}")
def proper_nouns(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", F.array_sort(T.proper_nouns("text")).alias("names"))


FRAGS = "(SELECT DISTINCT id, text FROM fragments)"


def fragments(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "fragments", "id", "text", *more).dropDuplicates(["id"])


@query(
    f"SELECT id, regexp_extract_all(text, '(^|[^0-9.])([0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}})(?:$|[^0-9.])', 2) AS codes, "
    f"regexp_extract_all(text, '20[0-9]{{2}}[/-]20[0-9]{{2}}') AS years FROM {FRAGS}"
)
def extract_codes(spark: SparkSession, d: str) -> DataFrame:
    return fragments(spark, d).select("id", T.found("text", T.CODE).alias("codes"), T.found("text", T.YEARS).alias("years"))


@query(f"SELECT id, sha256(text) AS hash, sha256(text) = text_hash AS same FROM (SELECT DISTINCT id, text, text_hash FROM fragments)")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return fragments(spark, d, "text_hash").select("id", T.content_hash("text").alias("hash"), (T.content_hash("text") == F.col("text_hash")).alias("same"))


PAGES = "(SELECT DISTINCT id, url, title, clean_text AS text, raw_html FROM pages)"


def pages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "pages", "id", *columns).dropDuplicates(["id"])


KINDS = " ".join(f"WHEN contains(url, '{p}') THEN '{k}'" for p, k, _ in rescoring.URL_KINDS)
FACTORS = " ".join(f"WHEN '{k}' THEN {f}" for _, k, f in rescoring.URL_KINDS)
URL_KIND = f"CASE WHEN coalesce(url, '') = '' THEN 'none' WHEN regexp_matches(url, '^https?://[^/]+/?$') THEN 'root' {KINDS} ELSE 'general' END"


@query(f"SELECT id, substr(sha256(url), 1, 16) AS url_id, kind, CASE kind WHEN 'root' THEN 0.15 {FACTORS} ELSE 1.0 END::DOUBLE AS factor FROM (SELECT id, url, {URL_KIND} AS kind FROM {PAGES})")
def url_kind(spark: SparkSession, d: str) -> DataFrame:
    kinds = pages(spark, d, "url").select("id", T.url_id("url").alias("url_id"), rescoring.url_kind(F.col("url")).alias("kind"))
    return kinds.withColumn("factor", rescoring.url_factor(F.col("kind")))


@query(
    f"""SELECT id, coalesce(nullif(trim(title, ' '), ''), nullif(trim(regexp_replace(regexp_extract(raw_html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), ' '), ''),
    trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]+)/*$', 1), '-?[0-9]*$', ''), '[-_]+', ' ', 'g'), ' ')) AS title FROM {PAGES}"""
)
def page_title(spark: SparkSession, d: str) -> DataFrame:
    h1 = F.trim(F.regexp_replace(F.regexp_extract("raw_html", "(?s)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", ""))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(h1, F.lit("")), T.title_from_url("url"))
    return pages(spark, d, "url", "title", "raw_html").select("id", title.alias("title"))


@query(
    f"""SELECT id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_html, '<(script|style)[^>]*>[^<]*</(script|style)>', '', 'g'),
    '</?(p|div|li|tr|h[1-6]|td|br|section|table|ul)[^>]*>', chr(10), 'gi'), '<[^>]+>', '', 'g'), '[ \\t]+', ' ', 'g'), ' '), '\\s*\\n\\s*', chr(10), 'g') AS plain FROM {PAGES} WHERE raw_html IS NOT NULL"""
)
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.regexp_replace("raw_html", "<(script|style)[^>]*>[^<]*</(script|style)>", "")
    t = F.regexp_replace(t, "(?i)</?(p|div|li|tr|h[1-6]|td|br|section|table|ul)[^>]*>", "\n")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", ""), "[ \\t]+", " "))
    return pages(spark, d, "raw_html").where("raw_html is not null").select("id", F.regexp_replace(t, "[ \\t\\n\\r\\f]*\\n[ \\t\\n\\r\\f]*", "\n").alias("plain"))


@query(f"""SELECT href, count(*) AS n, count(DISTINCT id) AS pages FROM (SELECT id, unnest(regexp_extract_all(raw_html, 'href="([^"]*)"', 1)) AS href FROM {PAGES}) GROUP BY 1""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    links = pages(spark, d, "raw_html").select("id", F.explode(F.regexp_extract_all("raw_html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("href").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("pages"))


@query(
    """WITH t AS (SELECT doc_id AS id, text, length(text) AS n FROM documents WHERE length(text) > 0),
    s AS (SELECT id, text, n, unnest(generate_series(0, greatest(n - 1, 0), 700)) AS start FROM t),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS chunk_index FROM s WHERE start = 0 OR start + 100 < n)
    SELECT id, chunk_index::INT AS chunk_index, start::INT AS start, sha256(substr(text, start + 1, 800)) AS hash FROM k WHERE length(trim(substr(text, start + 1, 800), ' ')) >= 50"""
)
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    return chunking.fixed_windows(docs).select("id", "chunk_index", "start", F.sha2("text", 256).alias("hash"))


@query(
    r"""WITH p AS (SELECT doc_id AS id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t]*\n+'), lambda p: trim(p, ' ')), lambda p: p <> '') AS parts FROM documents WHERE text IS NOT NULL),
    f AS (SELECT id, string_split(list_reduce(parts, lambda a, p: CASE WHEN length(string_split(a, chr(1))[-1]) < 50 THEN a || chr(10) || p ELSE a || chr(1) || p END), chr(1)) AS folded FROM p WHERE len(parts) > 0),
    c AS (SELECT id, flatten(list_transform(folded, lambda p: CASE WHEN length(p) > 1000 THEN list_transform(regexp_extract_all(p, '(?s).{1,799}[ \n]|.{1,800}'), lambda x: trim(x, ' ')) ELSE [p] END)) AS chunks FROM f)
    SELECT id, (generate_subscripts(chunks, 1) - 1)::INT AS chunk_index, unnest(chunks) AS text FROM c"""
)
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraphs(table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id"))


@query(
    f"""SELECT id, n::INT AS n, s AS sentence FROM (SELECT id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS n FROM (
    SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([!?;]|[^0-9][.])[ \\t]+', '\\1' || chr(1), 'g'), '[\\x01\\n]'), lambda s: trim(s, ' ')), lambda s: s <> '') AS l FROM {FRAGS}))"""
)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return fragments(spark, d).select("id", F.posexplode(T.sentences("text")).alias("n", "sentence"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return html.structures(pages(spark, d, "url", "raw_html").withColumnRenamed("raw_html", "html"))


@query()
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of pages under their headings."""
    return html.sections(_parsed(spark, d)).select("id", "position", "level", "title", F.size("parent_titles").alias("depth"), F.length("text").alias("chars"))


@query()
def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the pages' tables as lines, each cell with its column's head."""
    return html.table_lines(_parsed(spark, d))


@query()
def section_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Pages parsed anew into fragments with their headings, codes and years."""
    return chunking.section_fragments(html.sections(_parsed(spark, d)))


DOMAIN = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"


@query(f"SELECT host, allowed, count(*) AS pages FROM (SELECT {DOMAIN} AS host, {DOMAIN} IN (SELECT site FROM sources WHERE enabled) AND NOT regexp_matches(lower(url), '\\.(jpg|png|zip|mp4)$|/login|/search') AS allowed FROM {PAGES}) GROUP BY 1, 2")
def url_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Addresses by host, and whether they are of an enabled source and none to skip."""
    sites = table(spark, d, "sources", "site", "enabled").where("enabled").select(F.col("site").alias("host"), F.lit(True).alias("known")).distinct()
    urls = pages(spark, d, "url").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"), (~F.lower("url").rlike("\\.(jpg|png|zip|mp4)$|/login|/search")).alias("wanted"))
    return urls.join(sites, "host", "left").groupBy("host", (F.coalesce("known", F.lit(False)) & F.col("wanted")).alias("allowed")).agg(F.count(F.lit(1)).alias("pages"))


REPLIES = "(SELECT DISTINCT turn_id AS id, bot_reply AS text FROM dialog_turns WHERE bot_reply IS NOT NULL)"
DB_CLAIMS = {
    "code": ("(^|[^0-9.])([0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}})(?:$|[^0-9.])", 2), "date": ("(^|[^0-9])([0-9]{{1,2}}\\.[0-9]{{1,2}}\\.20[0-9]{{2}})(?:$|[^0-9])", 2),
    "money": ("([0-9]{{1,3}}(?: [0-9]{{3}})+) руб", 1), "mail": ("([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+)", 1),
    "phone": ("((?:\\+7|8)?[ -]?\\(?[0-9]{{3}}\\)?[ -]?[0-9]{{3}}[ -]?[0-9]{{2}}[ -]?[0-9]{{2}})(?:$|[^0-9])", 1),
}
#: Claims ``id, kind, value`` of ``{rows}`` (id, text).
CLAIM_SQL = " UNION ALL ".join(f"SELECT id, '{k}' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(text, '{p}', {g}), lambda v: trim(v, ' ')))) AS value FROM {{rows}}" for k, (p, g) in DB_CLAIMS.items())


@query(CLAIM_SQL.format(rows=REPLIES))
def extract_claims(spark: SparkSession, d: str) -> DataFrame:
    replies = table(spark, d, "dialog_turns", "turn_id", "bot_reply").dropDuplicates(["turn_id"]).select(F.col("turn_id").alias("id"), F.col("bot_reply").alias("text"))
    return grounding.claims(replies)


@query(
    """SELECT source, count(*) AS documents, count(DISTINCT lang) AS languages, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest,
    sum(CASE WHEN extracted_text IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS scanned FROM documents GROUP BY 1"""
)
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "source", "lang", "n_chars", "extracted_text")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("lang").alias("languages"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"),
        F.sum(F.col("extracted_text").isNotNull().cast("int")).alias("scanned"),
    )


@query(
    """SELECT source_id, count(*) AS pages, sum(CASE WHEN coalesce(clean_text, '') = '' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN version_number > 1 THEN 1 ELSE 0 END)::BIGINT AS updated
    FROM (SELECT DISTINCT id, source_id, clean_text, version_number FROM pages) GROUP BY 1"""
)
def crawl_counts(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d, "source_id", "clean_text", "version_number")
    return p.groupBy("source_id").agg(F.count(F.lit(1)).alias("pages"), F.sum((F.coalesce("clean_text", F.lit("")) == "").cast("int")).alias("failed"), F.sum((F.col("version_number") > 1).cast("int")).alias("updated"))
