"""Queries of answering: search by words and vectors, support of claims, evidence, state of dialogs, the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladoga.functions import text as T
from ladoga.operators import changes, chunking, fusion, grounding, lexical, understanding, vector
from ladoga.plans.corpus import ASKED, CLAIM_SQL, FRAGS, NORM, QTERMS, STOPS, TERMS, fragments, questions
from ladoga.plans.dialogs import turns
from ladoga.plans.registry import registry
from ladoga.plans.retrieval import BM25, EVERY, EVIDENCE, FUSED, Q, asked, evidence
from ladoga.workspace import cut, table

QUERIES, SQL, query = registry()

#: Fragments with the version of what they were cut from now, and the version that was stored with them.
VERSIONED = """(SELECT DISTINCT f.id, f.version_number AS recorded, coalesce(p.version_number, d.version_number) AS version
  FROM fragments f LEFT JOIN (SELECT DISTINCT id, version_number FROM pages) p ON p.id = f.page_id LEFT JOIN documents d ON d.doc_id = f.document_id)"""


def _valid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``id, vector`` of fragments that are still of the version their vector was made from."""
    f = table(spark, d, "fragments", "id", "page_id", "document_id", "version_number").dropDuplicates(["id"])
    p = table(spark, d, "pages", "id", "version_number").dropDuplicates(["id"]).select(F.col("id").alias("page_id"), F.col("version_number").alias("of_page"))
    o = table(spark, d, "documents", "doc_id", "version_number").select(F.col("doc_id").alias("document_id"), F.col("version_number").alias("of_document"))
    now = f.join(p, "page_id", "left").join(o, "document_id", "left").select("id", F.coalesce("of_page", "of_document").alias("version_number"), F.col("version_number").alias("content_version"))
    vectors = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.stale_free(vectors.join(now.select("id", "content_version"), "id"), now.select("id", "version_number"))


@query(f"SELECT id, version AS version_number FROM {VERSIONED} JOIN embeddings ON vec_id = id WHERE recorded = version")
def stale_vectors_excluded(spark: SparkSession, d: str) -> DataFrame:
    return _valid_vectors(spark, d).select("id", F.col("content_version").alias("version_number"))


#: Each ranking is cut to this many times as many as are wanted, so that fusion and what follows have a choice.
FETCH, WANTED = 3, 10


@query(
    f"""WITH v AS (SELECT id, embedding::DOUBLE[] AS v FROM {VERSIONED} JOIN embeddings ON vec_id = id WHERE recorded = version),
    qf AS (SELECT DISTINCT f.id AS query_id, coalesce(section_title, text) AS text FROM fragments f JOIN v USING (id) WHERE f.id % {EVERY} = 0),
    {BM25.replace(f"FROM {Q}", "FROM qf")},
    cs AS (SELECT q.id AS query_id, r.id, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM v q, v r WHERE q.id % {EVERY} = 0 AND q.id <> r.id),
    cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs),
    l AS (SELECT query_id, id, round(1 / (1 + exp(-score / 5)), 6) AS l FROM bmr WHERE rank <= {FETCH * WANTED} AND id <> query_id),
    s AS (SELECT query_id, id, score AS s FROM cr WHERE rank <= {FETCH * WANTED}),
    w AS (SELECT query_id, id, round(CASE WHEN l IS NOT NULL AND s IS NOT NULL THEN 0.4 * l + 0.6 * s WHEN l IS NOT NULL THEN l ELSE 0.6 * s END, 6) AS score FROM l FULL JOIN s USING (query_id, id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM w) WHERE rank <= {WANTED}"""
)
def vector_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Fragments like given ones: BM25 of their title and cosine of their stored vectors, stale vectors left out, fused."""
    vectors = cut(_valid_vectors(spark, d).select("id", "vector"))
    given = vectors.where(f"id % {EVERY} = 0").select(F.col("id").alias("query_id"), "vector")
    texts = table(spark, d, "fragments", "id", "section_title", "text").dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.coalesce("section_title", "text").alias("text"))
    terms = lexical.query_terms(texts.join(given.select("query_id"), "query_id"))
    words = lexical.top_k(lexical.bm25(fragments(spark, d), cut(terms)), FETCH * WANTED).where("id <> query_id").select("query_id", "id", F.round(1 / (1 + F.exp(-F.col("score") / 5)), 6).alias("score"))
    near = vector.cosine_top_k(vectors, given, FETCH * WANTED).select("query_id", "id", "score")
    return lexical.top_k(fusion.weighted(words, near), WANTED)


REPLY_CLAIMS = CLAIM_SQL.format(rows="(SELECT DISTINCT turn_id AS id, bot_reply AS text FROM dialog_turns WHERE bot_reply IS NOT NULL)")
FORM = "CASE kind WHEN 'phone' THEN regexp_replace(regexp_replace(value, '[^0-9]', '', 'g'), '^[78]([0-9]{10})$', '\\1') WHEN 'money' THEN regexp_replace(value, '\\s', '', 'g') ELSE lower(value) END"


@query(
    f"""WITH c AS (SELECT id, kind, value, {FORM} AS form FROM ({REPLY_CLAIMS})),
    e AS (SELECT kind, {FORM} AS form, count(DISTINCT id) AS n FROM ({CLAIM_SQL.format(rows=FRAGS)}) GROUP BY 1, 2)
    SELECT id, kind, value, coalesce(n, 0) AS fragments, n IS NOT NULL AS supported FROM c LEFT JOIN e USING (kind, form)"""
)
def claims_support_strict(spark: SparkSession, d: str) -> DataFrame:
    """Claims of replies with how many fragments state the same, both sides in the normal form of their kind."""
    there = grounding.stated_by(grounding.claims(fragments(spark, d)))
    stated = grounding.claims(_replies(spark, d)).withColumn("form", grounding.claim_form())
    return stated.join(there, ["kind", "form"], "left").select("id", "kind", "value", F.coalesce("fragments", F.lit(0)).alias("fragments"), F.col("fragments").isNotNull().alias("supported"))


@query(
    f"""WITH c AS (SELECT id, kind, value, {FORM} AS form FROM ({REPLY_CLAIMS})),
    e AS (SELECT DISTINCT kind, form, norm FROM (SELECT kind, {FORM} AS form, {NORM.format('text')} AS norm FROM ({CLAIM_SQL.format(rows=FRAGS)}) JOIN {FRAGS} USING (id)))
    SELECT c.id, kind, value, coalesce(bool_or(contains(norm, lower(value))), false) AS supported FROM c LEFT JOIN e USING (kind, form) GROUP BY c.id, kind, value"""
)
def claims_support_compat(spark: SparkSession, d: str) -> DataFrame:
    """The same with values as written, which must stand in the normal form of a fragment; signs in a value prevent that.

    How a value is written is compared with each way a fragment writes it, not with each fragment.
    """
    stated = grounding.claims(_replies(spark, d)).withColumn("form", grounding.claim_form())
    frags = fragments(spark, d)
    there = grounding.claims(frags).join(frags, "id").select("kind", grounding.claim_form().alias("form"), F.col("value").alias("there"), T.normalize("text").alias("norm"))
    wanted = there.join(stated.select("kind", "form", F.lower("value").alias("as_written")).distinct(), ["kind", "form"])
    hits = wanted.groupBy("kind", "form", "as_written").agg(F.max(F.contains("norm", "as_written")).alias("hit"))
    joined = stated.withColumn("as_written", F.lower("value")).join(hits, ["kind", "form", "as_written"], "left")
    return joined.select("id", "kind", "value", F.coalesce("hit", F.lit(False)).alias("supported"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dialog_turns", "turn_id", "bot_reply").where("bot_reply is not null").dropDuplicates(["turn_id"])
    return t.select(F.col("turn_id").alias("id"), F.col("bot_reply").alias("text"))


@query(
    f"""WITH {FUSED}, {EVIDENCE} SELECT query_id, id, rank FROM ev a WHERE NOT EXISTS (SELECT 1 FROM ev b WHERE b.query_id = a.query_id AND b.id <> a.id
    AND contains({NORM.format('b.text')}, {NORM.format('a.text')}) AND (length({NORM.format('b.text')}) > length({NORM.format('a.text')}) OR b.rank < a.rank))"""
)
def contained_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence without pieces that stand in a longer or an equal, better ranked piece for the same question."""
    return fusion.not_contained(cut(evidence(spark, d)).withColumn("norm", T.normalize("text"))).select("query_id", "id", "rank")


@query(f"WITH {BM25}, n_terms AS (SELECT query_id, count(*) AS terms FROM q GROUP BY 1) SELECT query_id, id FROM bm JOIN n_terms USING (query_id) WHERE matched = terms")
def all_terms_match(spark: SparkSession, d: str) -> DataFrame:
    """Fragments that have every term of a question."""
    terms = cut(lexical.query_terms(asked(spark, d)))
    every = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("terms"))
    return lexical.bm25(fragments(spark, d), terms).join(every, "query_id").where("matched = terms").select("query_id", "id")


@query(f"""SELECT id, array_to_string(list_transform({TERMS.format('text')}, lambda w: CASE WHEN length(w) >= 4 THEN '"' || w || '"*' ELSE '"' || w || '"' END), ' OR ') AS match FROM {ASKED}""")
def match_expression(spark: SparkSession, d: str) -> DataFrame:
    """Questions as full-text expressions: each word quoted, longer ones also as beginnings, any of them."""
    words = F.transform(T.tokens("text"), lambda w: F.concat(F.lit('"'), w, F.when(F.length(w) >= 4, '"*').otherwise('"')))
    return questions(spark, d).select("id", F.array_join(words, " OR ").alias("match"))


_RU_NAME = "(^|[^\\p{L}])(\\p{Lu}\\p{Ll}+ \\p{Lu}\\p{Ll}+(?:ович|евич|овна|евна|ична)(?: \\p{Lu}\\p{Ll}+)?|\\p{Lu}\\p{Ll}+ \\p{Lu}\\.[ ]?\\p{Lu}\\.)"


@query(f"SELECT turn_id AS id, list_distinct(regexp_extract_all(user_message, '{_RU_NAME}', 2)) AS names FROM (SELECT DISTINCT turn_id, user_message FROM dialog_turns WHERE user_message IS NOT NULL) WHERE regexp_matches(user_message, '{_RU_NAME}')")
def named_persons(spark: SparkSession, d: str) -> DataFrame:
    """Messages that seem to name a person: a capitalised word before a patronymic or initials."""
    t = table(spark, d, "dialog_turns", "turn_id", "user_message").where(F.col("user_message").rlike(_RU_NAME)).dropDuplicates(["turn_id"])
    return t.select(F.col("turn_id").alias("id"), F.array_distinct(F.regexp_extract_all("user_message", F.lit(_RU_NAME), F.lit(2))).alias("names"))


@query(f"SELECT id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_extract(text, '(?s)^(.{{0,199}})[ \\n]', 1) || '…' END AS short FROM {FRAGS}")
def truncated(spark: SparkSession, d: str) -> DataFrame:
    """Fragments cut at the last blank before 200 characters."""
    return fragments(spark, d).select("id", chunking.shortened(F.col("text"), 200).alias("short"))


HEAD = "^[ \\t]*[0-9]+\\.([0-9]+\\.)*[ \\t]"


@query(
    f"""WITH l AS (SELECT id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS n FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
    r AS (SELECT *, sum(regexp_matches(line, '{HEAD}')::INT) OVER (PARTITION BY id ORDER BY n)::INT AS record FROM l)
    SELECT id, record, min(n)::INT AS first_line, count(*)::INT AS lines, sum(length(line))::BIGINT AS chars FROM r GROUP BY 1, 2"""
)
def record_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut before each numbered line."""
    docs = table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    r = chunking.records(docs, HEAD)
    return r.groupBy("id", "record").agg(F.min("line_no").alias("first_line"), F.count(F.lit(1)).cast("int").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query(
    """WITH l AS (SELECT id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS n, x[1] AS head FROM (SELECT doc_id AS id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
    c AS (SELECT id, head, line, n, (n - 1) // 20 AS chunk FROM l WHERE n > 0)
    SELECT id, chunk::INT AS chunk_index, count(*)::INT AS lines, sha256(head || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS hash FROM c GROUP BY id, head, chunk"""
)
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut after every twentieth line, the first line repeated over each part."""
    docs = table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id")
    return chunking.lines_under_head(docs, 20).select("id", "chunk_index", "lines", T.content_hash("text").alias("hash"))


ADDRESS = "regexp_replace(regexp_replace(lower(regexp_extract({0}, '^(https?://[^/?#]+)', 1)) || regexp_extract({0}, '^https?://[^/?#]+([^#]*)', 1), '/+$', ''), '^http:', 'https:')"


@query(
    f"""WITH known AS (SELECT DISTINCT id, {ADDRESS.format('url')} AS address FROM pages),
    found AS (SELECT DISTINCT {ADDRESS.format('url')} AS address FROM (SELECT url FROM documents UNION ALL SELECT final_url FROM pages) WHERE regexp_matches(url, '^https?://')),
    fresh AS (SELECT DISTINCT address FROM found, (SELECT site FROM sources WHERE enabled) WHERE address NOT IN (SELECT address FROM known)
      AND (regexp_extract(address, '^https://([^/:?]+)', 1) = site OR ends_with(regexp_extract(address, '^https://([^/:?]+)', 1), '.' || site)))
    SELECT address, (SELECT max(id) FROM known) + row_number() OVER (ORDER BY sha256(address)) AS id FROM fresh"""
)
def url_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of enabled sites and their subdomains that are no page yet, with the ids they get."""
    known = table(spark, d, "pages", "id", "url").select("id", T.address("url").alias("address"))
    urls = table(spark, d, "documents", "url").unionByName(table(spark, d, "pages", "final_url").withColumnRenamed("final_url", "url"))
    found = urls.where(F.col("url").rlike("^https?://")).select(T.address("url").alias("address")).distinct()
    fresh = found.join(known.select("address").distinct(), "address", "left_anti")
    # every suffix of a host that begins after a dot may be a site, so subdomains are an equality join too
    host = F.split(F.regexp_extract("address", "^https://([^/:?]+)", 1), "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(host)), lambda i: F.array_join(F.slice(host, i, F.size(host)), "."))
    sites = table(spark, d, "sources", "site", "enabled").where("enabled").select("site").distinct()
    fresh = fresh.select("address", F.explode(suffixes).alias("site")).join(sites, "site").select("address").distinct()
    return changes.numbered(fresh, F.sha2("address", 256), known.agg(F.max("id")).head()[0] or 0)


STATE = "(SELECT DISTINCT turn_id, session_id, user_message, is_ambiguous, turn_ts FROM dialog_turns WHERE session_id IS NOT NULL)"


@query(
    f"""WITH l AS (SELECT turn_id, user_message, is_ambiguous, turn_ts, lag(is_ambiguous) OVER w AS pa, lag(user_message) OVER w AS pm, lag(turn_ts) OVER w AS pt
      FROM {STATE} WINDOW w AS (PARTITION BY session_id ORDER BY turn_ts, turn_id)),
    p AS (SELECT *, coalesce(pa, false) AND turn_ts <= pt + INTERVAL 30 MINUTE AS answers FROM l)
    SELECT turn_id, coalesce(answers, false) AS answers, CASE WHEN answers THEN concat_ws(' ', pm, user_message) ELSE user_message END AS question, coalesce(is_ambiguous, false) AS pending FROM p"""
)
def pending_clarification(spark: SparkSession, d: str) -> DataFrame:
    """A turn soon after one that needed clarification answers it, and its question is both together; whether it leaves
    one pending itself."""
    t = table(spark, d, "dialog_turns", "turn_id", "session_id", "user_message", "is_ambiguous", "turn_ts").where("session_id is not null").dropDuplicates(["turn_id"])
    return understanding.clarified(t)


_CODE_SQL = "nullif(regexp_extract({0}, '(^|[^0-9.])([0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{2}})($|[^0-9.])', 2), '')"


@query(
    f"""WITH e AS (SELECT turn_id, session_id, turn_ts, {_CODE_SQL.format('user_message')} AS code FROM (SELECT DISTINCT turn_id, session_id, turn_ts, user_message FROM dialog_turns WHERE session_id IS NOT NULL)),
    l AS (SELECT turn_id, code, [lag(code, 5) OVER w, lag(code, 4) OVER w, lag(code, 3) OVER w, lag(code, 2) OVER w, lag(code, 1) OVER w] AS p FROM e WINDOW w AS (PARTITION BY session_id ORDER BY turn_ts, turn_id))
    SELECT turn_id, coalesce(code, list_filter(p, lambda x: x IS NOT NULL)[-1]) AS code, code IS NULL AND len(list_filter(p, lambda x: x IS NOT NULL)) > 0 AS inherited FROM l"""
)
def inherited_entity(spark: SparkSession, d: str) -> DataFrame:
    """A message that names no specialty is about that of the last of five turns before that names one."""
    t = turns(spark, d).withColumn("code", F.get(T.found("user_message", T.CODE), F.lit(0)))
    w = understanding.with_previous(t, "session_id", "turn_ts", "turn_id", 5, F.col("code"))
    known = F.filter("previous", lambda x: x.isNotNull())
    return w.select("turn_id", F.coalesce("code", F.try_element_at(known, F.lit(-1))).alias("code"), (F.col("code").isNull() & (F.size(known) > 0)).alias("inherited"))


@query(
    f"""WITH n AS (SELECT max(version_number) AS now FROM fragments)
    SELECT id, sha256(concat_ws('|', {NORM.format('question')}, coalesce(context_dialog, ''), coalesce(entities, ''), coalesce(resolved_date, ''), model, prompt_version)) AS key, index_version, now AS index_now, index_version = now AS valid
    FROM (SELECT DISTINCT id, question, context_dialog, entities, resolved_date, model, prompt_version, index_version FROM cache_keys WHERE question IS NOT NULL), n"""
)
def cache_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The key of each cached question, made of all that its answer depends on, and whether the index is still the one it
    was stored with."""
    k = table(spark, d, "cache_keys", "id", "question", "context_dialog", "entities", "resolved_date", "model", "prompt_version", "index_version").where("question is not null").dropDuplicates(["id"])
    now = table(spark, d, "fragments", "version_number").agg(F.max("version_number")).head()[0]
    return k.select("id", changes.cache_key("question", "context_dialog", "entities", "resolved_date", "model", "prompt_version").alias("key"), "index_version", F.lit(now).alias("index_now"), (F.col("index_version") == F.lit(now)).alias("valid"))


@query(
    f"""SELECT turn_id, coalesce(bot_reply <> '' AND NOT coalesce(is_ambiguous, false) AND confidence >= 0.5 AND len({TERMS.format('user_message')}) >= 2
      AND NOT list_has_any({TERMS.format('user_message')}, ['сегодня', 'завтра', 'сейчас', 'today', 'tomorrow', 'now']), false) AS cacheable
    FROM (SELECT DISTINCT turn_id, bot_reply, is_ambiguous, confidence, user_message FROM dialog_turns)"""
)
def cacheable_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies worth keeping: sure, not ambiguous, to a question of some words that doesn't depend on the day."""
    t = table(spark, d, "dialog_turns", "turn_id", "bot_reply", "is_ambiguous", "confidence", "user_message").dropDuplicates(["turn_id"])
    words = T.tokens("user_message")
    dated = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ("сегодня", "завтра", "сейчас", "today", "tomorrow", "now")]))
    keep = (F.col("bot_reply") != "") & ~F.coalesce("is_ambiguous", F.lit(False)) & (F.col("confidence") >= 0.5) & (F.size(words) >= 2) & ~dated
    return t.select("turn_id", F.coalesce(keep, F.lit(False)).alias("cacheable"))


@query(
    """WITH n AS (SELECT len(embedding) AS dims FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    stored AS (SELECT vec_id AS id, label FROM embeddings WHERE label < 6), incoming AS (SELECT vec_id AS id, label + 100 AS label FROM embeddings, n WHERE label >= 4 AND len(embedding) = dims)
    SELECT id, label FROM incoming UNION ALL SELECT id, label FROM stored WHERE id NOT IN (SELECT id FROM incoming)"""
)
def vectors_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A batch of vectors put over stored ones; those of another dimension than most are refused."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label").withColumnRenamed("vec_id", "id")
    incoming = vector.of_common_dimension(e.where("label >= 4"), e).select("id", (F.col("label") + 100).alias("label"))
    return changes.upsert(e.where("label < 6").select("id", "label"), incoming, ["id"])


@query()
def vector_blobs(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors as blobs of little-endian 32-bit numbers and back again."""
    e = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), "embedding")
    back = e.withColumn("blob", vector.to_blob("embedding")).withColumn("same", vector.from_blob("blob") == F.col("embedding"))
    return back.select("id", F.octet_length("blob").alias("bytes"), F.sha2("blob", 256).alias("hash"), "same")
