"""Fusing rankings, and choosing and packing evidence from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladoga.functions.text import byte_prefix


def reciprocal_ranks(*ranked: DataFrame, k: int = 60, first: int = 1) -> DataFrame:
    """``query_id, id, score``: the sum of 1/(k + rank) over rankings; ``first`` is the number of the best rank."""
    every = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        every = every.unionByName(r.select("query_id", "id", "rank"))
    return every.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank") - 1 + first)), 9).alias("score"))


def weighted(lexical: DataFrame, semantic: DataFrame, a: float = 0.4, b: float = 0.6) -> DataFrame:
    """``query_id, id, score``: a L + b S where both are there, L alone where only it is, b S where only S is."""
    both = lexical.select("query_id", "id", F.col("score").alias("l")).join(semantic.select("query_id", "id", F.col("score").alias("s")), ["query_id", "id"], "full")
    score = F.when(F.col("l").isNotNull() & F.col("s").isNotNull(), a * F.col("l") + b * F.col("s")).when(F.col("l").isNotNull(), F.col("l")).otherwise(b * F.col("s"))
    return both.select("query_id", "id", F.round(score, 6).alias("score"))


def first_by_prefix(ranked: DataFrame, keys: list[str], text: str = "text", size: int = 100) -> DataFrame:
    """Of results with equal ``keys`` and the same first ``size`` bytes of text the best ranked."""
    w = Window.partitionBy("query_id", *keys, "prefix").orderBy("rank", "id")
    return ranked.withColumn("prefix", byte_prefix(F.col(text), size)).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "prefix")


def above(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def not_contained(ranked: DataFrame) -> DataFrame:
    """Pieces ``query_id, id, rank, norm`` whose normal text stands in no longer one of the same query, nor in an equal
    one of better rank. A query has a few pieces, so they meet pairwise."""
    other = ranked.select("query_id", F.col("id").alias("_id"), F.col("rank").alias("_rank"), F.col("norm").alias("_norm"))
    held = F.contains("_norm", F.col("norm")) & ((F.length("_norm") > F.length("norm")) | (F.col("_rank") < F.col("rank")))
    gone = ranked.join(other, "query_id").where((F.col("id") != F.col("_id")) & held).select("query_id", "id").distinct()
    return ranked.join(gone, ["query_id", "id"], "left_anti")


def evidence(ranked: DataFrame, always: int = 4, more: int = 2, coverage: float = 0.4) -> DataFrame:
    """The first ``always`` of each query, and of the others the first ``more`` whose share of keywords found reaches
    ``coverage``."""
    ok = (F.col("rank") > always) & (F.col("coverage") >= coverage)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("nth", F.sum(ok.cast("int")).over(w)).where((F.col("rank") <= always) | (ok & (F.col("nth") <= more))).drop("nth")


def pack(ranked: DataFrame, budget: int = 4800, most: int = 5, overhead: int = 50) -> DataFrame:
    """The first results whose texts fit the byte budget, up to the first that doesn't; the very first always."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sized = ranked.where(F.col("rank") <= most).withColumn("used", F.sum(F.octet_length("text") + overhead).over(w))
    return sized.where((F.col("used") <= budget) | (F.col("rank") == 1))


def sufficiency(ranked: DataFrame, score: float = 0.25, least: int = 2, coverage: float = 0.6, top: int = 5) -> DataFrame:
    """``query_id, strong, best_coverage, sufficient``: enough strong results, or enough keywords in the first ones."""
    strong = F.sum((F.col("score") > score).cast("int"))
    best = F.round(F.max(F.when(F.col("rank") <= top, F.col("coverage"))), 6)
    return ranked.groupBy("query_id").agg(strong.alias("strong"), best.alias("best_coverage")).withColumn("sufficient", (F.col("strong") >= least) | (F.col("best_coverage") >= coverage))
