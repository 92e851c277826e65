"""Queries of retrieval: index, ranking, fusion, evidence. The questions are those whose id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladoga.functions import text as T
from ladoga.operators import fusion, grounding, lexical, rescoring, understanding, vector
from ladoga.plans.corpus import FRAGS, QTERMS, URL_KIND, _topic, fragments
from ladoga.plans.registry import registry
from ladoga.workspace import broadcast_within, cut, once, table

QUERIES, SQL, query = registry()

EVERY = 100
Q = f"(SELECT DISTINCT request_id AS query_id, question AS text FROM chat_requests WHERE question IS NOT NULL AND request_id % {EVERY} = 0)"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
BM25 = f"""
f AS (SELECT id, {WORDS} AS w FROM {FRAGS}),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM f),
post AS (SELECT id, term, count(*) AS tf, max(length) AS length FROM (SELECT id, len(w) AS length, unnest(w) AS term FROM f) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
idf AS (SELECT term, df, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, n),
q AS (SELECT query_id, unnest({QTERMS.format('text')}) AS term FROM {Q}),
bm AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS matched
  FROM post JOIN idf USING (term) JOIN q USING (term), n GROUP BY 1, 2),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm),
tfs AS (SELECT query_id, id, round(sum(tf::DOUBLE / (tf + 1)) + max(length) / 10000 * 0.1, 6) AS score FROM post JOIN q USING (term) GROUP BY 1, 2),
tfr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM tfs)"""


def asked(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "chat_requests", "request_id", "question").where(f"question is not null and request_id % {EVERY} = 0")
    return q.select(F.col("request_id").alias("query_id"), F.col("question").alias("text")).dropDuplicates(["query_id"])


def _ranked(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return lexical.top_k(lexical.bm25(fragments(spark, d), lexical.query_terms(asked(spark, d))), k)


def _saturated(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return lexical.top_k(lexical.tf_saturation(fragments(spark, d), lexical.query_terms(asked(spark, d))), k)


def _both(spark: SparkSession, d: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both rankings over one index."""
    return lexical.both_top_k(once(table(spark, d, "fragments", "id", "text"), "id"), cut(lexical.query_terms(asked(spark, d))), k)


@query(f"WITH {BM25} SELECT term, df, sum(tf)::BIGINT AS cf FROM post JOIN df USING (term) GROUP BY 1, 2")
def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_statistics(lexical.postings(fragments(spark, d)))


@query(f"WITH {BM25} SELECT id, count(*) AS terms, sum(tf)::BIGINT AS words, max(length) AS length FROM post GROUP BY 1")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(fragments(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("words"), F.max("length").alias("length"))


@query(f"WITH {BM25} SELECT query_id, id, score, matched, rank FROM bmr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


@query(f"WITH {BM25} SELECT query_id, id, round(1 / (1 + exp(-score / 5)), 6) AS squashed FROM bmr WHERE rank <= 10")
def bm25_squashed(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("query_id", "id", F.round(1 / (1 + F.exp(-F.col("score") / 5)), 6).alias("squashed"))


@query(
    f"""WITH {BM25}, p AS (SELECT DISTINCT query_id, substr(term, 1, 5) AS prefix FROM q WHERE length(term) >= 5),
    h AS (SELECT id, prefix, sum(tf) AS tf, max(length) AS length FROM post, (SELECT DISTINCT prefix FROM p) WHERE starts_with(term, prefix) GROUP BY 1, 2),
    d AS (SELECT prefix, count(*) AS df FROM h GROUP BY 1),
    i AS (SELECT prefix, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM d, n),
    s AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h JOIN i USING (prefix) JOIN p USING (prefix), n GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""
)
def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    terms = lexical.query_terms(asked(spark, d)).where(F.length("term") >= 5)
    prefixes = cut(terms.select("query_id", F.substring("term", 1, 5).alias("prefix")).distinct())
    return lexical.prefix_top_k(once(table(spark, d, "fragments", "id", "text"), "id"), prefixes, 10)


@query(
    f"""WITH p AS (SELECT query_id, unnest(list_zip(w[:len(w)-1], w[2:])) AS z FROM (SELECT query_id, {WORDS} AS w FROM {Q}) WHERE len(w) > 1),
    ph AS (SELECT DISTINCT query_id, z[1] AS first, z[2] AS second FROM p),
    t AS (SELECT id, unnest(list_zip(w[:len(w)-1], w[2:])) AS z FROM (SELECT id, {WORDS} AS w FROM {FRAGS}) WHERE len(w) > 1)
    SELECT query_id, id, count(*) AS n FROM t JOIN ph ON z[1] = first AND z[2] = second GROUP BY 1, 2"""
)
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    w = asked(spark, d).select("query_id", T.index_tokens("text").alias("w"))
    pairs = w.select("query_id", F.explode(F.arrays_zip(F.col("w").alias("first"), F.slice("w", F.lit(2), F.size("w")).alias("second"))).alias("p"))
    phrases = pairs.select("query_id", "p.first", "p.second").where("second is not null").distinct()
    return lexical.phrase_counts(fragments(spark, d), phrases)


@query(f"WITH {BM25} SELECT query_id, id, score, rank FROM tfr WHERE rank <= 10")
def tf_saturation(spark: SparkSession, d: str) -> DataFrame:
    return _saturated(spark, d)


RRF = "rrf AS (SELECT query_id, id, round(sum(1.0 / ({k} + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM bmr WHERE rank <= 10 UNION ALL SELECT query_id, id, rank FROM tfr WHERE rank <= 10) GROUP BY 1, 2)"


@query(f"WITH {BM25}, {RRF.format(k=60)} SELECT query_id, id, score FROM rrf")
def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal_ranks(*_both(spark, d))


@query(f"WITH {BM25}, {RRF.format(k=59)} SELECT query_id, id, score FROM rrf")
def fuse_rrf0(spark: SparkSession, d: str) -> DataFrame:
    """Ranks counted from 0."""
    return fusion.reciprocal_ranks(*_both(spark, d), first=0)


@query(
    f"""WITH {BM25} SELECT query_id, id, round(CASE WHEN l IS NOT NULL AND s IS NOT NULL THEN 0.4 * l + 0.6 * s WHEN l IS NOT NULL THEN l ELSE 0.6 * s END, 6) AS score
    FROM (SELECT query_id, id, score AS l FROM bmr WHERE rank <= 10) FULL JOIN (SELECT query_id, id, score AS s FROM tfr WHERE rank <= 10) USING (query_id, id)"""
)
def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted(*_both(spark, d))


COV = f"len(list_intersect(terms, {QTERMS.format('text')}))::DOUBLE / len(terms)"
FUSED = f"""{BM25}, {RRF.format(k=60)},
r0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rrf),
r1 AS (SELECT r0.*, f.text, f.url_stable FROM r0 JOIN (SELECT DISTINCT id, text, url_stable FROM fragments) f USING (id)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id, url_stable, array_slice(encode(text), 1, 100) ORDER BY rank, id) AS k FROM r1),
r3 AS (SELECT query_id, id, score, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r2 WHERE k = 1),
ql AS (SELECT query_id, {QTERMS.format('text')} AS terms FROM {Q}),
fused AS (SELECT query_id, id, score, text, rank, round(CASE WHEN len(terms) > 0 THEN {COV} ELSE 0.0 END, 6) AS coverage FROM r3 JOIN ql USING (query_id))"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Both rankings fused, near duplicates of one address left out, ranked anew, with texts and keyword coverage."""
    rrf = cut(lexical.top_k(fusion.reciprocal_ranks(*_both(spark, d)), 20))
    texts = table(spark, d, "fragments", "id", "text", "url_stable").join(broadcast_within(rrf.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"])
    first = fusion.first_by_prefix(rrf.join(texts, "id").repartition("query_id"), ["url_stable"]).withColumnRenamed("rank", "before")
    ranked = lexical.top_k(first.withColumn("order", -F.col("before")), 20, score="order").drop("order", "before")
    terms = asked(spark, d).select("query_id", T.question_terms("text").alias("terms"))
    return ranked.join(terms, "query_id").withColumn("coverage", F.round(rescoring.coverage(F.col("terms"), F.col("text")), 6)).select("query_id", "id", "score", "text", "rank", "coverage")


@query(f"WITH {FUSED} SELECT query_id, id, rank FROM fused")
def dedup_url_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "id", "rank")


EVIDENCE = "ev AS (SELECT * FROM (SELECT *, sum(CASE WHEN rank > 4 AND coverage >= 0.4 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM fused) WHERE rank <= 4 OR (coverage >= 0.4 AND nth <= 2))"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return fusion.evidence(_fused(spark, d))


@query(f"WITH {FUSED}, {EVIDENCE} SELECT query_id, id, rank, coverage FROM ev")
def evidence_select(spark: SparkSession, d: str) -> DataFrame:
    return fusion.evidence(_fused(spark, d)).select("query_id", "id", "rank", "coverage")


@query(f"WITH {FUSED} SELECT query_id, id, used FROM (SELECT *, sum(strlen(text) + 50) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS used FROM fused WHERE rank <= 5) WHERE used <= 4800 OR rank = 1")
def pack_budget(spark: SparkSession, d: str) -> DataFrame:
    return fusion.pack(_fused(spark, d)).select("query_id", "id", "used")


@query(
    f"""WITH {FUSED} SELECT query_id, strong, best_coverage, strong >= 2 OR best_coverage >= 0.6 AS sufficient FROM (
    SELECT query_id, sum(CASE WHEN score > 0.03 THEN 1 ELSE 0 END)::BIGINT AS strong, round(max(CASE WHEN rank <= 5 THEN coverage END), 6) AS best_coverage FROM fused GROUP BY 1)"""
)
def sufficiency(spark: SparkSession, d: str) -> DataFrame:
    return fusion.sufficiency(_fused(spark, d), score=0.03)


@query(f"WITH {FUSED} SELECT query_id, id, score FROM fused WHERE score >= 0.02")
def threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    return fusion.above(_fused(spark, d), 0.02).select("query_id", "id", "score")


@query(f"WITH {FUSED}, {EVIDENCE} SELECT query_id, id, score, rank FROM ev WHERE rank <= 5")
def hybrid_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Questions to their five best pieces of evidence: index, two rankings, fusion, duplicates out, evidence."""
    return fusion.evidence(_fused(spark, d)).where("rank <= 5").select("query_id", "id", "score", "rank")


@query(
    f"""WITH {BM25}, c AS (SELECT b.query_id, b.id, b.score AS base, qq.text AS question, f.section_title, f.specialty_code, p.url
      FROM (SELECT * FROM bmr WHERE rank <= 10) b JOIN {Q} qq USING (query_id) JOIN (SELECT DISTINCT id, section_title, specialty_code, page_id FROM fragments) f USING (id)
      LEFT JOIN (SELECT DISTINCT id AS page_id, url FROM pages) p ON p.page_id = f.page_id),
    k AS (SELECT *, {URL_KIND} AS kind, {QTERMS.format('question')} AS qt, {QTERMS.format("coalesce(section_title, '')")} AS st FROM c),
    s AS (SELECT query_id, id, base, CASE WHEN {_topic('question')} = {_topic("coalesce(section_title, '')")} THEN 0.15 ELSE 0.0 END::DOUBLE AS context, CASE WHEN coalesce(contains(question, specialty_code), false) THEN 0.4 ELSE 0.0 END::DOUBLE AS code,
      round(CASE WHEN len(qt) > 0 THEN 0.15 * len(list_intersect(qt, st)) / len(qt) ELSE 0.0 END, 6) AS section,
      CASE kind WHEN 'root' THEN 0.15 {" ".join(f"WHEN '{n}' THEN {v}" for _, n, v in rescoring.URL_KINDS)} ELSE 1.0 END::DOUBLE AS factor FROM k)
    SELECT *, round((base + code + section + context) * factor + 1e-9, 6) AS score FROM s"""
)
def score_bonus(spark: SparkSession, d: str) -> DataFrame:
    ranked = _ranked(spark, d).join(asked(spark, d).withColumnRenamed("text", "question"), "query_id")
    frags = table(spark, d, "fragments", "id", "section_title", "specialty_code", "page_id").dropDuplicates(["id"])
    urls = table(spark, d, "pages", "id", "url").dropDuplicates(["id"]).withColumnRenamed("id", "page_id")
    cand = ranked.join(frags, "id").join(urls, "page_id", "left")
    cand = cand.withColumn("topic", understanding.topic(F.col("question"))).withColumn("text_topic", understanding.topic(F.coalesce("section_title", F.lit(""))))
    return rescoring.rescored(cand)


@query(
    f"""WITH {BM25}, c AS (SELECT query_id, id, score, {URL_KIND} AS kind FROM (SELECT * FROM bmr WHERE rank <= 10) JOIN (SELECT DISTINCT id, page_id FROM fragments) USING (id)
      JOIN (SELECT DISTINCT id AS page_id, url FROM pages) USING (page_id))
    SELECT query_id, id, kind FROM (SELECT *, max(CASE WHEN kind <> 'root' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS s FROM c) WHERE kind <> 'root' OR s = 0"""
)
def homepage_filter(spark: SparkSession, d: str) -> DataFrame:
    frags = table(spark, d, "fragments", "id", "page_id").dropDuplicates(["id"])
    urls = table(spark, d, "pages", "id", "url").dropDuplicates(["id"]).select(F.col("id").alias("page_id"), rescoring.url_kind(F.col("url")).alias("kind"))
    return rescoring.without_roots(_ranked(spark, d).join(frags, "id").join(urls, "page_id")).select("query_id", "id", "kind")


@query(
    f"""WITH {FUSED}, best AS (SELECT query_id, max(coverage) AS coverage FROM fused WHERE rank <= 5 GROUP BY 1),
    s AS (SELECT query_id, coalesce(coverage, 0) >= 0.6 AS passed FROM {Q} LEFT JOIN best USING (query_id))
    SELECT count(*) AS questions, sum(passed::INT)::BIGINT AS passed, round(100.0 * sum(passed::INT) / count(*), 2) AS percent, sum(passed::INT) >= 0.8 * count(*) AS gate FROM s"""
)
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """How many questions have evidence with most of their words among the first five, and whether that is enough."""
    best = _fused(spark, d).where("rank <= 5").groupBy("query_id").agg(F.max("coverage").alias("coverage"))
    s = asked(spark, d).join(best, "query_id", "left").select((F.coalesce("coverage", F.lit(0.0)) >= 0.6).cast("int").alias("p"))
    out = s.agg(F.count(F.lit(1)).alias("questions"), F.sum("p").alias("passed"))
    return out.withColumn("percent", F.round(100.0 * F.col("passed") / F.col("questions"), 2)).withColumn("gate", F.col("passed") >= 0.8 * F.col("questions"))


VEC = "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"
COSINE = f"""c AS (SELECT q.id AS query_id, r.id, round(list_cosine_similarity(q.v, r.v), 6) AS score FROM ({VEC}) q, ({VEC}) r WHERE q.id % {EVERY} = 0 AND q.id <> r.id)"""


@query(f"WITH {COSINE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vector.cosine_top_k(v, v.where(f"id % {EVERY} = 0").select(F.col("id").alias("query_id"), "vector"), 10)


@query("SELECT DISTINCT id, text_hash FROM fragments WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings", "vec_id").withColumnRenamed("vec_id", "id")
    return vector.missing_vectors(table(spark, d, "fragments", "id", "text_hash").dropDuplicates(["id"]), vectors)


@query(
    """WITH e AS (SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(DISTINCT id) FROM fragments) AS fragments,
    (SELECT count(DISTINCT f.id) FROM fragments f JOIN embeddings e ON e.vec_id = f.id) AS embedded) SELECT *, round(100.0 * embedded / fragments, 4) AS percent FROM e"""
)
def embedding_status(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "fragments", "id").distinct()
    vectors = table(spark, d, "embeddings", "vec_id").withColumn("v", F.lit(1))
    both = ids.join(vectors, F.col("id") == F.col("vec_id"), "full")
    counts = both.agg(F.count("v").alias("vectors"), F.count("id").alias("fragments"), F.sum((F.col("id").isNotNull() & F.col("v").isNotNull()).cast("int")).alias("embedded"))
    return counts.withColumn("percent", F.round(100.0 * F.col("embedded") / F.col("fragments"), 4))


SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace({0}, '([!?;]|[^0-9][.])[ \\t]+', '\\1' || chr(1), 'g'), '[\\x01\\n]'), lambda s: trim(s, ' ')), lambda s: s <> '')"


@query(
    f"""WITH {FUSED}, {EVIDENCE},
    x AS (SELECT query_id, id, rank, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS n FROM (SELECT query_id, id, rank, {SENTENCES.format('text')} AS l FROM ev)),
    m AS (SELECT x.*, len(list_intersect({QTERMS.format('sentence')}, terms)) AS matched, len(terms) AS n_terms FROM x JOIN ql USING (query_id) WHERE NOT ends_with(sentence, '?')),
    k AS (SELECT *, 10 * matched - rank AS score, row_number() OVER (PARTITION BY query_id, sentence ORDER BY rank, id, n) AS k FROM m WHERE matched > 0 AND matched >= 0.5 * n_terms)
    SELECT query_id, place::INT AS place, id, sentence, matched::INT AS matched FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, id, n) AS place FROM k WHERE k = 1) WHERE place <= 4"""
)
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of the evidence that have most of each question's words."""
    return grounding.extractive_answers(cut(evidence(spark, d)), asked(spark, d))


SYNONYMS = [("экзамены", "испытания"), ("стоит", "стоимость"), ("обучение", "учеба"), ("документы", "справки"), ("общежитие", "проживание")]
_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS)


@query(
    f"""WITH {BM25}, s(term, synonym) AS (VALUES {_VALUES}), n_terms AS (SELECT query_id, count(*) AS terms FROM q GROUP BY 1), first AS (SELECT * FROM bmr WHERE rank <= 10),
    weak AS (SELECT query_id FROM first JOIN n_terms USING (query_id) GROUP BY query_id, terms HAVING max(matched::DOUBLE / terms) < 0.6),
    more AS (SELECT query_id, term FROM q JOIN weak USING (query_id) UNION SELECT query_id, synonym FROM q JOIN weak USING (query_id) JOIN s USING (term)),
    again AS (SELECT query_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM post JOIN idf USING (term) JOIN more USING (term), n GROUP BY 1, 2),
    second AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM again) WHERE rank <= 10),
    every AS (SELECT query_id, id, max(score) AS score FROM (SELECT query_id, id, score FROM first UNION ALL SELECT query_id, id, score FROM second) GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM every) WHERE rank <= 10"""
)
def retried_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions whose evidence doesn't suffice are asked again with synonyms; both results are joined, the better rank kept."""
    index, terms = lexical.indexed(fragments(spark, d)), cut(lexical.query_terms(asked(spark, d)))
    first = cut(lexical.top_k(lexical.bm25(index, terms), 10))
    words = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    weak = first.join(words, "query_id").groupBy("query_id").agg(F.max(F.col("matched") / F.col("n")).alias("c")).where("c < 0.6").select("query_id")
    more = understanding.synonym_expansion(terms.join(weak, "query_id", "left_semi"), spark.createDataFrame(SYNONYMS, "term string, synonym string"))
    second = lexical.top_k(lexical.bm25(index, more), 10)
    every = first.unionByName(second).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return lexical.top_k(every, 10)
