"""Queries over versions, merges, caches, sessions and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladoga.functions import text as T
from ladoga.operators import changes, sessions
from ladoga.plans.corpus import NORM
from ladoga.plans.registry import registry
from ladoga.workspace import table

QUERIES, SQL, query = registry()

#: Pages fetched before this are the state, later ones arrive; also the time at which cached answers are asked for.
AS_OF = "2026-07-01 00:00:00"
P = "(SELECT DISTINCT id, url, content_hash, version_number, fetched_at FROM pages)"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "pages", "id", "url", "content_hash", "version_number", "fetched_at").dropDuplicates(["id"])
    newest = lambda df: changes.latest(df, ["url"], F.desc("fetched_at"), F.desc("id")).withColumnRenamed("version_number", "version")
    return newest(p.where(F.col("fetched_at") < F.lit(AS_OF).cast("timestamp_ntz"))), newest(p.where(F.col("fetched_at") >= F.lit(AS_OF).cast("timestamp_ntz")))


HALVES = f"""a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, id DESC) AS k FROM {P} WHERE fetched_at < TIMESTAMP '{AS_OF}') WHERE k = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, id DESC) AS k FROM {P} WHERE fetched_at >= TIMESTAMP '{AS_OF}') WHERE k = 1)"""


@query(
    f"""WITH {HALVES}, s AS (SELECT url, a.version_number AS v, CASE WHEN a.version_number IS NULL THEN 'new' WHEN b.url IS NULL THEN 'missing'
      WHEN a.content_hash IS NOT DISTINCT FROM b.content_hash THEN 'unchanged' ELSE 'updated' END AS status FROM a FULL JOIN b USING (url))
    SELECT url, status, (coalesce(v, 0) + (status IN ('new', 'updated'))::INT)::INT AS version FROM s"""
)
def crawl_merge(spark: SparkSession, d: str) -> DataFrame:
    return changes.merge_by_hash(*_halves(spark, d), "url", "content_hash")


@query(f"WITH {HALVES} SELECT url, content_hash, version_number AS version FROM b UNION ALL SELECT url, content_hash, version_number FROM a WHERE url NOT IN (SELECT url FROM b)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("url", "content_hash", "version") for x in _halves(spark, d))
    return changes.upsert(a, b, ["url"])


@query(f"WITH {HALVES} SELECT url, content_hash, version_number AS version FROM a UNION ALL SELECT url, content_hash, version_number FROM b WHERE url NOT IN (SELECT url FROM a)")
def insert_missing(spark: SparkSession, d: str) -> DataFrame:
    a, b = (x.select("url", "content_hash", "version") for x in _halves(spark, d))
    return changes.insert_missing(a, b, ["url"])


F_ = "(SELECT DISTINCT id, url_stable, text_hash, version_number, created_at FROM fragments WHERE url_stable IS NOT NULL)"


@query(
    f"""WITH c AS (SELECT id, url_stable, created_at, coalesce((lag(text_hash) OVER w <> text_hash)::INT, 1) AS changed FROM {F_} WINDOW w AS (PARTITION BY url_stable ORDER BY created_at, id))
    SELECT id, url_stable, sum(changed) OVER (PARTITION BY url_stable ORDER BY created_at, id)::INT AS version FROM c"""
)
def version_history(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fragments", "id", "url_stable", "text_hash", "created_at").where("url_stable is not null").dropDuplicates(["id"])
    return changes.version_history(f, "url_stable", "created_at", "text_hash").select("id", "url_stable", "version")


@query("SELECT coalesce(max(version_number), 0) AS index_version, count(DISTINCT id) AS fragments FROM fragments")
def index_version(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fragments", "id", "version_number").agg(F.coalesce(F.max("version_number"), F.lit(0)).alias("index_version"), F.count_distinct("id").alias("fragments"))


CK = "(SELECT DISTINCT id, question, entities, model, index_version, created_at FROM cache_keys)"
NK = NORM.format("question")


@query(f"SELECT id, norm FROM (SELECT id, {NK} AS norm, row_number() OVER (PARTITION BY {NK} ORDER BY created_at DESC, id DESC) AS k FROM {CK} WHERE question IS NOT NULL) WHERE k = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _latest_keys(spark, d).select("id", "norm")


def _latest_keys(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "cache_keys", "id", "question", "index_version", "created_at").where("question is not null").dropDuplicates(["id"])
    return changes.latest(k.withColumn("norm", T.normalize("question")), ["norm"], F.desc("created_at"), F.desc("id"))


@query(
    f"""WITH k AS (SELECT id, norm, created_at FROM (SELECT id, created_at, {NK} AS norm, row_number() OVER (PARTITION BY {NK} ORDER BY created_at DESC, id DESC) AS k FROM {CK} WHERE question IS NOT NULL) WHERE k = 1),
    q AS (SELECT DISTINCT request_id, question, received_at FROM chat_requests WHERE question IS NOT NULL)
    SELECT request_id, k.id AS key_id, received_at >= created_at AND received_at < created_at + INTERVAL 7 DAY AS fresh FROM q JOIN k ON {NORM.format('q.question')} = norm"""
)
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Questions that are in the cache, and whether its entry was there and no older than a week when they came."""
    q = table(spark, d, "chat_requests", "request_id", "question", "received_at").where("question is not null").dropDuplicates(["request_id"])
    keys = _latest_keys(spark, d).select(F.col("id").alias("key_id"), "norm", "created_at")
    fresh = (F.col("received_at") >= F.col("created_at")) & (F.col("received_at") < F.col("created_at") + F.expr("interval 7 days"))
    return q.withColumn("norm", T.normalize("question")).join(keys, "norm").select("request_id", "key_id", fresh.alias("fresh"))


@query(
    f"""WITH r AS (SELECT id AS entry_id, entities::JSON->>'$.specialty' AS code, index_version AS version FROM {CK} WHERE entities IS NOT NULL),
    c AS (SELECT specialty_code AS code, max(version_number) AS now FROM fragments WHERE specialty_code IS NOT NULL GROUP BY 1)
    SELECT entry_id, count(*) AS n, sum((now IS NULL)::INT)::BIGINT AS missing, coalesce(sum((now <> version)::INT), 0)::BIGINT AS stale, bool_and(coalesce(now = version, false)) AS valid
    FROM r LEFT JOIN c USING (code) WHERE code IS NOT NULL GROUP BY 1"""
)
def cache_dependency_valid(spark: SparkSession, d: str) -> DataFrame:
    """Whether cached entries still hold by the versions of the fragments of their specialty."""
    k = table(spark, d, "cache_keys", "id", "entities", "index_version").where("entities is not null").dropDuplicates(["id"])
    recorded = k.select(F.col("id").alias("entry_id"), F.get_json_object("entities", "$.specialty").alias("id"), F.col("index_version").alias("version")).where("id is not null")
    current = table(spark, d, "fragments", "specialty_code", "version_number").where("specialty_code is not null").groupBy(F.col("specialty_code").alias("id")).agg(F.max("version_number").alias("version"))
    return changes.dependency_state(recorded, current)


@query(
    """WITH r AS (SELECT DISTINCT request_id, session_id, received_at AS t FROM chat_requests WHERE session_id IS NOT NULL AND received_at IS NOT NULL),
    m AS (SELECT *, CASE WHEN t < lag(t) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY session_id ORDER BY t, request_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY t, request_id) AS run FROM m)
    SELECT session_id, min(t) AS started, max(t) AS ended, count(*) AS n FROM g GROUP BY session_id, run"""
)
def sessions_idle30(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "chat_requests", "request_id", "session_id", "received_at").dropDuplicates(["request_id"])
    return sessions.idle_sessions(r, "session_id", "received_at")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def metrics_window(spark: SparkSession, d: str) -> DataFrame:
    w = sessions.metric_windows(table(spark, d, "events", "ts", "event_type", "value"), "ts", "1 hour", "event_type")
    return w.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@query(
    """SELECT s.id, s.site, count(DISTINCT p.id) AS pages, count(DISTINCT d.doc_id) AS documents FROM sources s LEFT JOIN (SELECT DISTINCT id, source_id FROM pages) p ON p.source_id = s.id
    LEFT JOIN (SELECT DISTINCT doc_id, source_id FROM documents) d ON d.source_id = s.id GROUP BY 1, 2"""
)
def source_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Sources with how many pages and documents they have, each side counted before it is joined."""
    p = table(spark, d, "pages", "id", "source_id").dropDuplicates(["id"]).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("pages"))
    o = table(spark, d, "documents", "doc_id", "source_id").dropDuplicates(["doc_id"]).groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, d, "sources", "id", "site").join(p, "id", "left").join(o, "id", "left").fillna(0, ["pages", "documents"])


@query(
    """SELECT f.id, coalesce(p.url, d.url) AS url, coalesce(p.title, d.title) AS title, p.source_id IS NOT NULL AS from_page FROM (SELECT DISTINCT id, page_id, document_id FROM fragments) f
    LEFT JOIN (SELECT DISTINCT id, url, title, source_id FROM pages) p ON p.id = f.page_id LEFT JOIN (SELECT DISTINCT doc_id, url, title FROM documents) d ON d.doc_id = f.document_id"""
)
def fragment_parents(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with address and title of the page or the document they come from."""
    f = table(spark, d, "fragments", "id", "page_id", "document_id").dropDuplicates(["id"])
    p = table(spark, d, "pages", "id", "url", "title", "source_id").dropDuplicates(["id"]).select(F.col("id").alias("page_id"), F.col("url").alias("pu"), F.col("title").alias("pt"), "source_id")
    o = table(spark, d, "documents", "doc_id", "url", "title").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("document_id"), F.col("url").alias("du"), F.col("title").alias("dt"))
    joined = f.join(p, "page_id", "left").join(o, "document_id", "left")
    return joined.select("id", F.coalesce("pu", "du").alias("url"), F.coalesce("pt", "dt").alias("title"), F.col("source_id").isNotNull().alias("from_page"))


@query("SELECT id, (page_id IS NULL) = (document_id IS NULL) AS broken FROM (SELECT DISTINCT id, page_id, document_id FROM fragments) WHERE (page_id IS NULL) = (document_id IS NULL) OR page_id NOT IN (SELECT id FROM pages) OR document_id NOT IN (SELECT doc_id FROM documents)")
def orphan_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that have no single parent, or one that isn't there."""
    f = table(spark, d, "fragments", "id", "page_id", "document_id").dropDuplicates(["id"])
    broken = F.col("page_id").isNull() == F.col("document_id").isNull()
    no_page = f.where("page_id is not null").join(table(spark, d, "pages", "id").withColumnRenamed("id", "page_id"), "page_id", "left_anti")
    no_doc = f.where("document_id is not null").join(table(spark, d, "documents", "doc_id").withColumnRenamed("doc_id", "document_id"), "document_id", "left_anti")
    bad = f.where(broken).select("id").unionByName(no_page.select("id")).unionByName(no_doc.select("id")).distinct()
    return f.join(bad, "id").select("id", broken.alias("broken"))


@query(
    f"""WITH k AS (SELECT id, norm FROM (SELECT id, {NK} AS norm, row_number() OVER (PARTITION BY {NK} ORDER BY created_at DESC, id DESC) AS k FROM {CK} WHERE question IS NOT NULL) WHERE k = 1),
    h AS (SELECT {NORM.format('question')} AS norm, count(*) AS hits, max(received_at) AS last FROM (SELECT DISTINCT request_id, question, received_at FROM chat_requests WHERE question IS NOT NULL) GROUP BY 1)
    SELECT id, coalesce(hits, 0) AS hits, last FROM k LEFT JOIN h USING (norm)"""
)
def hit_counters(spark: SparkSession, d: str) -> DataFrame:
    """Cached questions with how often and when last they were asked; the questions are counted before the join."""
    q = table(spark, d, "chat_requests", "request_id", "question", "received_at").where("question is not null").dropDuplicates(["request_id"])
    hits = q.groupBy(T.normalize("question").alias("norm")).agg(F.count(F.lit(1)).alias("hits"), F.max("received_at").alias("last"))
    return _latest_keys(spark, d).join(hits, "norm", "left").select("id", F.coalesce("hits", F.lit(0)).alias("hits"), "last")


@query("SELECT DISTINCT f.id, f.page_id FROM fragments f WHERE f.page_id IS NULL OR f.page_id NOT IN (SELECT id FROM pages WHERE last_error IS NOT NULL)")
def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that are left when the pages whose last fetch failed are deleted."""
    gone = table(spark, d, "pages", "id", "last_error").where("last_error is not null").select(F.col("id").alias("page_id"))
    return table(spark, d, "fragments", "id", "page_id").dropDuplicates(["id"]).join(gone, "page_id", "left_anti").select("id", "page_id")


@query("SELECT id, site FROM sources WHERE enabled AND id NOT IN (SELECT source_id FROM pages WHERE source_id IS NOT NULL)")
def sources_without_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources", "id", "site", "enabled").where("enabled").select("id", "site").join(table(spark, d, "pages", "source_id").withColumnRenamed("source_id", "id"), "id", "left_anti")


@query(
    """SELECT id, json_array_length(parent_titles)::INT AS depth, parent_titles->>'$[0]' AS top FROM (SELECT DISTINCT id, parent_titles FROM fragments) WHERE parent_titles IS NOT NULL"""
)
def parent_titles(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fragments", "id", "parent_titles").where("parent_titles is not null").dropDuplicates(["id"])
    titles = F.from_json("parent_titles", "array<string>")
    return f.select("id", F.size(titles).alias("depth"), F.get(titles, F.lit(0)).alias("top"))


@query("SELECT id, text_hash FROM (SELECT id, text_hash, row_number() OVER (PARTITION BY array_slice(encode(text), 1, 100) ORDER BY id) AS k FROM (SELECT DISTINCT id, text, text_hash FROM fragments)) WHERE k = 1")
def dedup_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Of fragments with the same first 100 bytes the one with the smallest id; counted before and after the shuffle."""
    f = table(spark, d, "fragments", "id", "text", "text_hash").select("id", T.byte_prefix(F.col("text"), 100).alias("prefix"), "text_hash")
    return f.groupBy("prefix").agg(F.min("id").alias("id"), F.min_by("text_hash", "id").alias("text_hash")).select("id", "text_hash")


@query("SELECT id, page_id, substr(text, 1, 500) AS start FROM (SELECT DISTINCT id, page_id, text FROM fragments) WHERE (text LIKE '%общежит%' OR text LIKE '%стипенди%') AND page_id IS NOT NULL")
def like_search(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fragments", "id", "page_id", "text").where("page_id is not null")
    hit = F.contains("text", F.lit("общежит")) | F.contains("text", F.lit("стипенди"))
    return f.where(hit).select("id", "page_id", F.substring("text", 1, 500).alias("start")).dropDuplicates(["id"])


@query(
    """SELECT model, prompt_version, index_version, count(*) AS entries, min(created_at) AS first, max(created_at) AS last FROM
    (SELECT DISTINCT id, model, prompt_version, index_version, created_at FROM cache_keys) GROUP BY 1, 2, 3"""
)
def cache_versions(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "cache_keys", "id", "model", "prompt_version", "index_version", "created_at").dropDuplicates(["id"])
    return k.groupBy("model", "prompt_version", "index_version").agg(F.count(F.lit(1)).alias("entries"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))
