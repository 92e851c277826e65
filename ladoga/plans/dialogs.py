"""Queries that understand questions and dialogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladoga.functions import text as T
from ladoga.operators import lexical, understanding
from ladoga.plans.corpus import ASKED, FOLD, QTERMS, TERMS, _hits, _topic, questions
from ladoga.plans.registry import registry
from ladoga.plans.retrieval import SYNONYMS
from ladoga.workspace import table

QUERIES, SQL, query = registry()

@query(f"SELECT id, {_topic('text')} AS topic FROM {ASKED}")
def topic_argmax(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", understanding.topic(F.col("text")).alias("topic"))


ENTITY = {
    "code": "nullif(regexp_extract(text, '(^|[^0-9.])([0-9]{2}\\.[0-9]{2}\\.[0-9]{2})($|[^0-9.])', 2), '')", "year": "nullif(regexp_extract(text, '20[0-9]{2}[/-]20[0-9]{2}'), '')",
    "grp": "nullif(regexp_extract(upper(text), '(^|[^А-ЯЁA-Z])([А-ЯЁA-Z]{2}-[0-9]{2})($|[^0-9])', 2), '')", "course": "nullif(regexp_extract(lower(text), '([0-9]) курс', 1), '')",
}


@query(f"SELECT id, {', '.join(f'{e} AS {k}' for k, e in ENTITY.items())} FROM {ASKED}")
def entities(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("e")
    return questions(spark, d).withColumn("e", understanding.entities(F.col("text"))).select("id", e["code"].alias("code"), e["year"].alias("year"), e["group"].alias("grp"), e["course"].alias("course"))


@query(f"SELECT id, list_filter([{', '.join(f'CASE WHEN {_hits(w, chr(116) + chr(101) + chr(120) + chr(116))} > 0 THEN {chr(39)}{k}{chr(39)} END' for k, w in understanding.CONDITIONS.items())}], lambda c: c IS NOT NULL) AS conditions FROM {ASKED}")
def conditions(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("id", understanding.conditions(F.col("text")).alias("conditions"))


@query(
    f"""SELECT id, {' OR '.join(f"starts_with({FOLD.format('text')}, '{g}')" for g in understanding.GREETINGS)} AS greeting,
    coalesce({TERMS.format('text')}[1] IN ({', '.join(repr(w) for w in understanding.FOLLOW_UPS)}), false) AS follow_up,
    len({TERMS.format('text')}) < 3 OR ({_topic('text')} IS NULL AND coalesce({', '.join(ENTITY.values())}) IS NULL) AS vague FROM {ASKED}"""
)
def intent_flags(spark: SparkSession, d: str) -> DataFrame:
    return understanding.intent(questions(spark, d)).select("id", "greeting", "follow_up", "vague")


@query(f"WITH t AS (SELECT coalesce({_topic('text')}, '-') AS topic FROM {ASKED}) SELECT topic, count(*) AS questions, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM t GROUP BY 1")
def topic_report(spark: SparkSession, d: str) -> DataFrame:
    by = questions(spark, d).groupBy(F.coalesce(understanding.topic(F.col("text")), F.lit("-")).alias("topic")).agg(F.count(F.lit(1)).alias("questions"))
    total = by.agg(F.sum("questions")).first()[0] or 1
    return by.withColumn("percent", F.round(100.0 * F.col("questions") / F.lit(total), 4))


_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS)


@query(f"WITH t AS (SELECT id AS query_id, unnest({QTERMS.format('text')}) AS term FROM {ASKED}), s(term, synonym) AS (VALUES {_VALUES}) SELECT query_id, term FROM t UNION SELECT query_id, synonym FROM t JOIN s USING (term)")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    terms = lexical.query_terms(questions(spark, d).withColumnRenamed("id", "query_id"))
    return understanding.synonym_expansion(terms, spark.createDataFrame(SYNONYMS, "term string, synonym string"))


TURNS = "(SELECT DISTINCT turn_id, session_id, user_message, topic, turn_ts FROM dialog_turns WHERE session_id IS NOT NULL)"


def turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dialog_turns", "turn_id", "session_id", "user_message", "topic", "turn_ts").where("session_id is not null")
    return t.dropDuplicates(["turn_id"])


@query(
    f"""SELECT turn_id, list_transform(list_filter([lag(turn_id, 3) OVER w, lag(turn_id, 2) OVER w, lag(turn_id, 1) OVER w], lambda x: x IS NOT NULL), lambda x: x) AS previous
    FROM {TURNS} WINDOW w AS (PARTITION BY session_id ORDER BY turn_ts, turn_id)"""
)
def dialog_window(spark: SparkSession, d: str) -> DataFrame:
    """The three turns before each turn of a dialog."""
    return understanding.with_previous(turns(spark, d), "session_id", "turn_ts", "turn_id", 3, F.col("turn_id")).select("turn_id", "previous")


@query(
    f"""WITH l AS (SELECT turn_id, topic, [lag(topic, 5) OVER w, lag(topic, 4) OVER w, lag(topic, 3) OVER w, lag(topic, 2) OVER w, lag(topic, 1) OVER w] AS p
    FROM {TURNS} WINDOW w AS (PARTITION BY session_id ORDER BY turn_ts, turn_id))
    SELECT turn_id, coalesce(topic, list_filter(p, lambda x: x IS NOT NULL)[-1]) AS topic, topic IS NULL AND len(list_filter(p, lambda x: x IS NOT NULL)) > 0 AS inherited FROM l"""
)
def inherited_topic(spark: SparkSession, d: str) -> DataFrame:
    """A turn without a topic takes that of the last of five turns before that has one."""
    w = understanding.with_previous(turns(spark, d), "session_id", "turn_ts", "turn_id", 5, F.col("topic"))
    known = F.filter("previous", lambda x: x.isNotNull())
    last = F.try_element_at(known, F.lit(-1))
    return w.select("turn_id", F.coalesce("topic", last).alias("topic"), (F.col("topic").isNull() & (F.size(known) > 0)).alias("inherited"))


@query(f"SELECT count(*) AS turns, sum((session_id IS NOT NULL AND regexp_full_match(session_id, '[0-9a-fA-F]{{32}}'))::INT)::BIGINT AS valid FROM (SELECT DISTINCT turn_id, session_id FROM dialog_turns)")
def session_id_valid(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dialog_turns", "turn_id", "session_id").dropDuplicates(["turn_id"])
    return t.agg(F.count(F.lit(1)).alias("turns"), F.sum(F.coalesce(F.col("session_id").rlike("^[0-9a-fA-F]{32}$"), F.lit(False)).cast("int")).alias("valid"))
