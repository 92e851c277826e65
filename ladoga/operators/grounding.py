"""Claims in answers, and whether evidence supports them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladoga.functions.text import CODE, DAY, MAIL, MONEY, PHONE, found, normalize, phone_digits, question_terms, sentences

CLAIMS = {"code": CODE, "date": DAY, "money": MONEY, "mail": MAIL, "phone": PHONE}


def claims(answers: DataFrame) -> DataFrame:
    """``id, kind, value``: codes, dates, amounts, mail addresses and phone numbers that a text states, each once."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(found(F.col("text"), pattern), lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value")))

    each = [of(k, p) for k, p in CLAIMS.items()]
    return answers.where("text is not null").select("id", F.explode(F.array_distinct(F.concat(*each))).alias("c")).select("id", "c.kind", "c.value")


def claim_form() -> Column:
    """The normal form of ``value`` by its ``kind``: digits of phones and amounts, lower case of others."""
    return F.when(F.col("kind") == "phone", phone_digits(F.col("value"))).when(F.col("kind") == "money", F.regexp_replace("value", "\\s", "")).otherwise(F.lower("value"))


def stated_by(stated: DataFrame) -> DataFrame:
    """``kind, form, fragments``: how many texts state each claim; counted before any join, so a hot claim is one row."""
    return stated.select("kind", claim_form().alias("form"), "id").distinct().groupBy("kind", "form").agg(F.count(F.lit(1)).alias("fragments"))


def supported(stated: DataFrame, evidence: DataFrame, strict: bool = True) -> DataFrame:
    """``stated`` (id, kind, value) with ``supported``: whether the evidence ``id, text`` of the same id states it.

    Strict: both sides are brought to the normal form of their kind. Otherwise the value as written must stand in the
    normalised evidence, which signs within a value often prevent.
    """
    if not strict:
        joined = stated.join(evidence.groupBy("id").agg(F.concat_ws(" ", F.collect_list(normalize("text"))).alias("all")), "id", "left")
        return joined.select("id", "kind", "value", F.coalesce(F.contains("all", F.lower("value")), F.lit(False)).alias("supported"))
    form = claim_form()
    there = claims(evidence).select("id", "kind", form.alias("form")).distinct().withColumn("supported", F.lit(True))
    return stated.withColumn("form", form).join(there, ["id", "kind", "form"], "left").select("id", "kind", "value", F.coalesce("supported", F.lit(False)).alias("supported"))


def extractive_answers(ranked: DataFrame, queries: DataFrame, most: int = 4, share: float = 0.5) -> DataFrame:
    """``query_id, place, id, sentence, matched``: of the sentences of each query's evidence that have at least ``share``
    of its terms the ``most`` best, those of better ranked texts first."""
    terms = queries.select("query_id", question_terms("text").alias("terms"))
    rows = ranked.select("query_id", "id", "rank", F.posexplode(sentences("text")).alias("n", "sentence")).where(~F.col("sentence").endswith("?"))
    matched = F.size(F.array_intersect(question_terms("sentence"), "terms"))
    scored = rows.join(terms, "query_id").withColumn("matched", matched).where((F.col("matched") > 0) & (F.col("matched") >= share * F.size("terms")))
    scored = scored.withColumn("score", 10 * F.col("matched") - F.col("rank"))
    once = scored.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "sentence").orderBy("rank", "id", "n"))).where("_k = 1")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "id", "n")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("query_id", "place", "id", "sentence", "matched")
