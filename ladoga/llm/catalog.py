"""The registered queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladoga.llm import encoding, lines, mainbody, mixing, packing, pii, scan, spans
from ladoga.workspace import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _texts(spark: SparkSession, d: str, *tables: tuple[str, str, str]) -> DataFrame:
    """``tbl, rec_id, text`` of the given (table, id, column)."""
    parts = [table(spark, d, t, key, text).select(F.lit(t).alias("tbl"), F.col(key).alias("rec_id"), F.col(text).alias("text")) for t, key, text in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


READ = (("pages", "id", "clean_text"), ("chat_requests", "request_id", "question"))
SAID = (("dialog_turns", "turn_id", "user_message"), ("cache_keys", "id", "question"))


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of which some word or sign was garbled by a wrong encoding."""
    return encoding.garbled_records(_texts(spark, d, *READ), table(spark, d, "documents", "lang", "text")).select("tbl", "rec_id")


@query
def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected records with their text restored and the chains of encodings undone."""
    return encoding.garbled_records(_texts(spark, d, *READ), table(spark, d, "documents", "lang", "text"))


def _pages_and_fragments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "pages", "id", "source_id", "clean_text"), table(spark, d, "fragments", "id", "page_id", "text")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of a line repeated within its source, in pages and in fragments of pages."""
    return lines.repeated_positions(*_pages_and_fragments(spark, d))


SQL["p2_found"] = r"""
WITH p AS (SELECT DISTINCT id, source_id, coalesce(clean_text, '') AS t FROM pages),
f AS (SELECT DISTINCT id, page_id, text AS t FROM fragments WHERE page_id IS NOT NULL),
rows AS (
  SELECT 'pages' AS tbl, id AS rec_id, id AS page_id, source_id, t FROM p
  UNION ALL SELECT 'fragments', f.id, f.page_id, p.source_id, f.t FROM f JOIN p ON p.id = f.page_id),
split AS (SELECT tbl, rec_id, page_id, source_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line_no FROM rows),
norm AS (SELECT * EXCLUDE line, regexp_replace(lower(trim(regexp_replace(line, '[ 	' || chr(160) || ']+', ' ', 'g'))), '[0-9]+', '0', 'g') AS line FROM split),
n AS (SELECT source_id, count(*) AS n FROM p GROUP BY 1),
df AS (SELECT source_id, line, count(DISTINCT page_id) AS pages FROM norm WHERE tbl = 'pages' AND line <> '' GROUP BY 1, 2)
SELECT tbl, rec_id, line_no::INT AS line_no FROM norm JOIN df USING (source_id, line) JOIN n USING (source_id) WHERE pages >= 3 AND pages * 5 >= n
"""


@query
def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Pages and their fragments without the lines repeated within their source."""
    return lines.without_repeated(*_pages_and_fragments(spark, d))


@query
def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate clusters of lines that stand in enough pages of a source, with their lines and counts."""
    return lines.repeated_lines(table(spark, d, "pages", "id", "source_id", "clean_text"), exact=False)


PAGE = ("id", "source_id", "title", "raw_html", "clean_text")


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The non-empty lines of each page that are no part of its body."""
    return mainbody.main_bodies(table(spark, d, "pages", *PAGE)).select("page_id", F.explode("around").alias("line_no"))


@query
def p3_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each page with its body only."""
    return mainbody.bodies_of(table(spark, d, "pages", *PAGE))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items of personal data with their kind and place."""
    return pii.found_spans(_texts(spark, d, *SAID)).where(F.col("kind").isin(*pii.KINDS)).select("tbl", "rec_id", "kind", "start_pos")


@query
def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Each text with its personal data replaced by placeholders of their type."""
    return pii.redact(_texts(spark, d, *SAID)).select("tbl", "rec_id", "redacted", F.size("spans").alias("items"))


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Running headers, page numbers, broken words and misread lines of scanned texts."""
    return scan.found_noise(table(spark, d, "documents", "doc_id", "text", "extracted_text"))


@query
def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """Scanned texts as continuous paragraphs."""
    return scan.repaired_texts(table(spark, d, "documents", "doc_id", "text", "extracted_text"))


@query
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document, or of each part of one that exceeds the capacity."""
    return packing.pack(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "pack_specs"))


@query
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers and the room used for each capacity."""
    specs = table(spark, d, "pack_specs")
    return packing.report(packing.pack(table(spark, d, "documents", "doc_id", "text"), specs), specs)


@query
def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """That every document is packed, whole or in parts that follow, and no container is overfull."""
    specs = table(spark, d, "pack_specs")
    return packing.invariants(packing.pack(table(spark, d, "documents", "doc_id", "text"), specs), specs)


SQL["p6_invariants"] = """SELECT spec_name, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0 AS overfull, 0 AS torn, 0 AS split_in_vain FROM pack_specs"""


def _mix_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "source", "lang", "doc_kind", "text").withColumnRenamed("doc_kind", "topic")


@query
def p7_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mix with their repeats."""
    return mixing.choose(_mix_documents(spark, d), table(spark, d, "mix_targets"))


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of each mix."""
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.choose(_mix_documents(spark, d), targets), targets)


@query
def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """That no document is taken more often than its source allows, none twice, none of a source that isn't listed."""
    targets = table(spark, d, "mix_targets")
    return mixing.invariants(mixing.choose(_mix_documents(spark, d), targets), targets)


SQL["p7_invariants"] = """SELECT mix_name, count(DISTINCT source) AS sources, 0 AS beyond_cap, 0 AS twice, 0 AS unlisted FROM mix_targets GROUP BY 1"""


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Longest runs of characters that stand verbatim, 200 or more at a stretch, in another document."""
    return spans.shared_spans(table(spark, d, "documents", "doc_id", "text"))


_SHARED = """WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, i AS s, hash(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM d)),
m AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
n AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (h)),
g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM n),
found AS (SELECT doc_id, min(s) AS start_pos, max(s) + 200 AS end_pos FROM g GROUP BY doc_id, run)"""
SQL["p8_found"] = f"{_SHARED} SELECT doc_id, start_pos, end_pos FROM found"
SQL["p8_report"] = f"""{_SHARED}, r AS (SELECT doc_id, sum(end_pos - start_pos)::BIGINT AS shared_chars, count(*) AS n_runs FROM found GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0) AS chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(n_runs, 0) AS n_runs,
CASE WHEN length(text) > 0 THEN coalesce(shared_chars, 0)::DOUBLE / length(text) ELSE 0.0 END AS share FROM (SELECT DISTINCT doc_id, text FROM documents) LEFT JOIN r USING (doc_id)"""


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's text that stands in other documents."""
    return spans.shared_report(table(spark, d, "documents", "doc_id", "text"))
