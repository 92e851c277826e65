"""Explainable scores: additive parts and ordered factors from rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladoga.functions.text import found, normalize, question_terms, stem

#: Address classes by a part of the path, the first that fits; kind and factor.
URL_KINDS: list[tuple[str, str, float]] = [
    ("/abitur/", "admission", 1.6), ("/teachers/", "staff", 2.0), ("/sveden/", "official", 1.3), ("/documents/", "documents", 1.2),
    ("/students/", "students", 1.2), ("/news/", "news", 0.9), ("/contacts/", "contacts", 1.5), ("/life/", "life", 1.4),
]


def url_kind(url: Column, kinds: list[tuple[str, str, float]] = URL_KINDS) -> Column:
    """The first class whose part of a path the address has; ``root`` for a bare host, else ``general``."""
    out = F.when(F.coalesce(url, F.lit("")) == "", "none").when(url.rlike("^https?://[^/]+/?$"), "root")
    for part, name, _ in kinds:
        out = out.when(F.contains(url, F.lit(part)), name)
    return out.otherwise("general")


def url_factor(kind: Column, kinds: list[tuple[str, str, float]] = URL_KINDS) -> Column:
    out = F.when(kind == "root", 0.15)
    for _, name, factor in kinds:
        out = out.when(kind == name, factor)
    return out.otherwise(1.0)


def rescored(candidates: DataFrame) -> DataFrame:
    """``query_id, id, base, code, section, context, factor, score``: parts of the final score of each candidate.

    The score is rounded half up to 6 digits, with a little added so that a tie in the last digit doesn't depend on the engine.

    ``candidates``: query_id, id, score, question, section_title, specialty_code, url, and the topics of both sides.
    """
    terms = question_terms("question")
    title = question_terms(F.coalesce("section_title", F.lit("")))
    code = F.when(F.coalesce(F.contains("question", F.col("specialty_code")), F.lit(False)), 0.4).otherwise(0.0)
    section = F.when(F.size(terms) > 0, 0.15 * F.size(F.array_intersect(terms, title)) / F.size(terms)).otherwise(0.0)
    context = F.when(F.coalesce(F.col("topic") == F.col("text_topic"), F.lit(False)), 0.15).otherwise(0.0)
    factor = url_factor(url_kind(F.col("url")))
    parts = candidates.select("query_id", "id", F.col("score").alias("base"), code.alias("code"), F.round(section, 6).alias("section"), context.alias("context"), factor.alias("factor"))
    return parts.withColumn("score", F.round((F.col("base") + F.col("code") + F.col("section") + F.col("context")) * F.col("factor") + 1e-9, 6))


def without_roots(scored: DataFrame) -> DataFrame:
    """Without bare hosts where the query has any other page."""
    w = Window.partitionBy("query_id")
    special = F.max((F.col("kind") != "root").cast("int")).over(w)
    return scored.withColumn("_s", special).where((F.col("kind") != "root") | (F.col("_s") == 0)).drop("_s")


def coverage(terms: Column, text: Column) -> Column:
    """The share of the terms among the words of the text."""
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, question_terms(text))) / F.size(terms)).otherwise(0.0)


def by_keywords(candidates: DataFrame) -> DataFrame:
    """``question, body`` with ``hit`` and ``relevance``: a quarter for each term of the question whose stem the text has, a
    half if it has all of at least three, three tenths of their share from a half on, and three tenths a code."""
    terms, norm = question_terms("question"), normalize("body")
    n = F.size(terms).cast("double")
    hit = F.size(F.filter(terms, lambda w: F.contains(norm, stem(w)))).cast("double")
    codes = F.array_distinct(found("question", "[0-9]{2}\\.[0-9]{2}\\.[0-9]{2}"))
    named = F.size(F.filter(codes, lambda e: F.contains(F.col("body"), e)))
    score = 0.25 * hit + F.when((n >= 3) & (hit == n), 0.5).otherwise(0.0) + F.when((n > 0) & (hit / n >= 0.5), 0.3 * hit / n).otherwise(0.0) + 0.3 * named
    return candidates.withColumn("hit", hit.cast("int")).withColumn("relevance", F.round(score, 6))
