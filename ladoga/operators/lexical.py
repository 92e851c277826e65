"""Lexical index and ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladoga.functions.text import index_tokens, question_terms
from ladoga.operators.changes import numbered
from ladoga.workspace import broadcast_within, cut

K1, B = 1.2, 0.75


def indexed(docs: DataFrame) -> DataFrame:
    """``id, w, length``: the words of each text, written once so that statistics, postings and several rankings read
    them instead of the texts."""
    return cut(docs.select("id", index_tokens("text").alias("w")).withColumn("length", F.size("w")))


def _words(docs: DataFrame) -> DataFrame:
    """``docs`` if it is indexed, else its words."""
    return docs if "w" in docs.columns else docs.select("id", index_tokens("text").alias("w")).withColumn("length", F.size("w"))


def postings(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``id, text`` to ``id, term, tf, length``; with ``only`` (a frame of ``term``) just for those terms.

    The terms asked for are joined before anything is shuffled, so an index lookup moves only matching postings.
    """
    each = _words(docs).select("id", "length", F.explode("w").alias("term"))
    if only is not None:
        each = each.join(broadcast_within(only.select("term").distinct()), "term", "left_semi")
    return each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))


def corpus_size(docs: DataFrame) -> tuple[int, float]:
    """Number of texts and their mean length in words."""
    r = _words(docs).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    return r["n"], r["mean"] or 1.0


def term_statistics(post: DataFrame) -> DataFrame:
    """``term, df, cf``: texts with the term, and its occurrences."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def idf(df: Column, n: int) -> Column:
    raw = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(1e-6)


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, text`` to ``query_id, term``, distinct."""
    return queries.select("query_id", F.explode(question_terms("text")).alias("term"))


def bm25(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, id, score, matched`` for every text that has a term of the query; the score is rounded to 6 digits."""
    docs = docs if "w" in docs.columns else indexed(docs)
    n, mean = corpus_size(docs)
    post = postings(docs, terms)
    return _scored(post, term_statistics(post), terms, n, mean)


#: Postings are stored in so many folders by the hash of the term, so that a question reads only those of its terms.
BUCKETS = 64


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int").alias("bucket")


def store_index(docs: DataFrame, folder: str) -> None:
    """The postings of ``id, text`` and what ranking needs to know of terms and texts, written once for many questions."""
    docs = indexed(docs)
    post = postings(docs)
    post.select("*", _bucket("term")).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    stored = docs.sparkSession.read.parquet(f"{folder}/postings")
    term_statistics(stored).select("*", _bucket("term")).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/terms")
    docs.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{folder}/size")


def bm25_stored(spark: SparkSession, folder: str, terms: DataFrame) -> DataFrame:
    """As ``bm25``, from a stored index; of it only the folders of the terms asked for are read."""
    size = spark.read.parquet(f"{folder}/size").head()
    asked = cut(terms)
    words = broadcast_within(cut(asked.select("term", _bucket("term")).distinct()))
    post, stats = (spark.read.parquet(f"{folder}/{name}").join(words, ["bucket", "term"], "left_semi") for name in ("postings", "terms"))
    return _scored(post.drop("bucket"), stats.drop("bucket"), asked, size["n"], size["mean"] or 1.0)


def _scored(post: DataFrame, stats: DataFrame, terms: DataFrame, n: int, mean: float) -> DataFrame:
    weights = stats.select("term", idf(F.col("df"), n).alias("idf"))
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    return (
        post.join(weights, "term")
        .join(terms, "term")
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    )


def tf_saturation(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``query_id, id, score``: each term's count saturates as c/(c+1); a little is added for length."""
    post = postings(docs, terms)
    c = F.col("tf").cast("double")
    return post.join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum(c / (c + 1)) + F.max("length") / 10000 * 0.1, 6).alias("score"))


def bm25_prefix(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """BM25 of ``query_id, prefix`` (three letters or more): a text's count is that of all words with the prefix."""
    n, mean = corpus_size(docs)
    each = _words(docs).select("id", "length", F.explode("w").alias("word")).withColumn("head", F.substring("word", 1, 3))
    asked = prefixes.select("prefix").distinct().withColumn("head", F.substring("prefix", 1, 3))
    hits = each.join(broadcast_within(asked), "head").where(F.col("word").startswith(F.col("prefix")))
    post = hits.groupBy("id", "prefix").agg(F.count(F.lit(1)).alias("tf"), F.max("length").alias("length"))
    weights = post.groupBy("prefix").agg(F.count(F.lit(1)).alias("df")).select("prefix", idf(F.col("df"), n).alias("idf"))
    tf = F.col("tf")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.lit(mean)))
    return post.join(weights, "prefix").join(prefixes, "prefix").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))


def phrase_counts(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``query_id, id, n``: how often the two-word phrase ``first, second`` of each query stands in each text."""
    pairs = _words(docs).select("id", F.explode(F.arrays_zip(F.col("w").alias("first"), F.slice("w", F.lit(2), F.size("w")).alias("second"))).alias("p")).select("id", "p.first", "p.second")
    return pairs.join(broadcast_within(phrases), ["first", "second"]).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))


def top_k(scored: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The best ``k`` of each query with their rank from 1; ties go to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: A task ranks so many texts for so many different questions.
ROWS, QUERIES = 20_000, 10_000
#: Scores closer than this may be equal once they are rounded.
_NEAR = 2e-6


def _largest(values: np.ndarray, k: int) -> float:
    """The ``k``-th largest, or 0 if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0.0


def _best(scores: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and rounded values of the best ``k`` positive scores, ties to the first; ``least`` is reached by ``k`` of them."""
    at = np.flatnonzero(scores >= max(least - _NEAR, 1e-300))
    rounded = np.floor(scores[at] * 1e6 + 0.5) / 1e6
    if len(at) > k:
        keep = rounded >= _largest(rounded, k)
        at, rounded = at[keep], rounded[keep]
    order = np.argsort(-rounded, kind="stable")[:k]
    return at[order], rounded[order]


def _block(k: int, mean: float, saturated: bool):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, np.ndarray, np.ndarray, bool]] = []
        if len(queries) and len(rows):
            rows = rows.sort_values("id", ignore_index=True)
            ids, length, size = rows["id"].to_numpy(), rows["length"].to_numpy(), len(rows)
            terms, first = np.unique(np.concatenate(queries["ts"].to_list()), return_index=True)
            idfs = np.concatenate(queries["idfs"].to_list())[first]
            t, doc = np.concatenate(rows["ts"].to_list()), np.repeat(np.arange(size), rows["ts"].map(len))
            place = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
            known = terms[place] == t
            key, tf = np.unique(place[known].astype(np.int64) * size + doc[known], return_counts=True)
            t, doc, tf = key // size, key % size, tf.astype(float)
            ends = np.searchsorted(t, np.arange(len(terms) + 1))
            part = idfs[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / mean))
            share, extra = tf / (tf + 1), length / 10000 * 0.1
            each = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
            # one term alone gives so many texts at least this score, so all others are passed over
            least = np.array([_largest(part[s], k) for s in each])
            enough = np.array([_largest(share[s] + extra[doc[s]], k) for s in each]) if saturated else least
            for set_id, ts in zip(queries["set_id"].to_numpy(), queries["ts"]):
                at = np.searchsorted(terms, ts)
                docs = np.concatenate([doc[each[i]] for i in at])
                if not len(docs):
                    continue
                out.append((set_id, *_best(np.bincount(docs, np.concatenate([part[each[i]] for i in at]), size), least[at].max(), k), False))
                if saturated:
                    shares = np.bincount(docs, np.concatenate([share[each[i]] for i in at]), size)
                    out.append((set_id, *_best(np.where(shares > 0, shares + extra, 0.0), enough[at].max(), k), True))
            out = [(s, ids[p], score, kind) for s, p, score, kind in out]
        many = [len(p) for _, p, _, _ in out]
        columns = {
            "set_id": np.repeat(np.array([s for s, *_ in out], np.int64), many), "id": np.concatenate([np.array([], np.int64), *[p for _, p, _, _ in out]]),
            "score": np.concatenate([np.array([], float), *[x for _, _, x, _ in out]]), "saturated": np.repeat(np.array([x for *_, x in out], bool), many),
        }
        return pd.DataFrame(columns)

    return run


def _ranked(each: DataFrame, asked: DataFrame, k: int, n: int, mean: float, saturated: bool) -> DataFrame:
    """``query_id, id, score, rank, saturated``: the best ``k`` of each query by BM25, and with ``saturated`` by saturated
    counts too.

    ``each`` (id, length, t) is a row for each place in a text of a term that is asked for, ``asked`` (query_id, t). Texts
    and queries are cut in blocks, and each pair of blocks is scored in one task, of which only the best leave it; so the
    pairs of a query and a text that has one of its terms are never written. Queries of the same terms are ranked once.
    """
    held = cut(each.groupBy("id").agg(F.collect_list("t").alias("ts"), F.max("length").alias("length")))
    weights = held.select(F.explode(F.array_distinct("ts")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).select("t", idf(F.col("df"), n).alias("idf"))
    sets = asked.join(weights, "t").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("t", "idf"))).alias("s")).select("query_id", F.col("s.t").alias("ts"), F.col("s.idf").alias("idfs"))
    sets = cut(sets.withColumn("set_id", F.min("query_id").over(Window.partitionBy("ts"))))
    different = sets.where("query_id = set_id").select("set_id", "ts", "idfs")
    nr, nq = (max(1, -(-df.count() // size)) for df, size in ((held, ROWS), (different, QUERIES)))
    rows = held.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    queries = different.withColumn("qb", F.pmod(F.xxhash64("set_id"), F.lit(nq)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    best = queries.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(_block(k, mean, saturated), "set_id long, id long, score double, saturated boolean")
    w = Window.partitionBy("set_id", "saturated").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return sets.select("query_id", "set_id").join(best, "set_id").select("query_id", "id", "score", "rank", "saturated")


def _numbers(terms: DataFrame, name: str) -> DataFrame:
    """``t``, a number, for each different value of a column."""
    return cut(numbered(terms.select(name).distinct(), F.sha2(name, 256)).select(name, F.col("id").cast("int").alias("t")))


def both_top_k(docs: DataFrame, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``query_id, id, score, rank`` of the best ``k`` of each query, ties to the smaller id: by ``bm25``, and by ``tf_saturation``."""
    n, mean = corpus_size(docs)
    words = _numbers(terms, "term")
    each = _words(docs).select("id", "length", F.explode("w").alias("term")).join(broadcast_within(words), "term")
    best = cut(_ranked(each, terms.join(words, "term").select("query_id", "t"), k, n, mean, True))
    return best.where("not saturated").drop("saturated"), best.where("saturated").drop("saturated")


def prefix_top_k(docs: DataFrame, prefixes: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank`` of the best ``k`` of each query by ``bm25_prefix``, ties to the smaller id."""
    n, mean = corpus_size(docs)
    heads = _numbers(prefixes, "prefix").withColumn("head", F.substring("prefix", 1, 3))
    each = _words(docs).select("id", "length", F.explode("w").alias("word")).withColumn("head", F.substring("word", 1, 3))
    hits = each.join(broadcast_within(heads), "head").where(F.col("word").startswith(F.col("prefix")))
    return _ranked(hits.select("id", "length", "t"), prefixes.join(heads, "prefix").select("query_id", "t"), k, n, mean, False).drop("saturated")
