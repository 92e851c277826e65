"""Exact nearest vectors by cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

ROWS, QUERIES = 20_000, 2_000


def _block(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": np.array([], np.int64), "id": np.array([], np.int64), "score": np.array([], float)})
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        q, r = (unit(np.stack(x["vector"].to_numpy()).astype(float)) for x in (queries, rows))
        score = np.round(q @ r.T, 6) + 0.0
        ids = rows["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        score, ids = score[:, order], ids[order]
        best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
        at = np.repeat(np.arange(len(queries)), best.shape[1])
        return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[at], "id": ids[best.ravel()], "score": score[at, best.ravel()]})

    return run


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` nearest of ``id, vector`` for each ``query_id, vector``, itself left out.

    Rows and queries are cut in blocks, and each pair of blocks is one matrix product in one task, of which the best are
    kept; so a task's memory is bounded however many of either there are. Null vectors are left out.
    """
    vectors, queries = vectors.where("vector is not null"), queries.where("vector is not null")
    nr, nq = (max(1, -(-df.count() // size)) for df, size in ((vectors, ROWS), (queries, QUERIES)))
    rows = vectors.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    near = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInPandas(_block(k), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return near.where("id <> query_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stale_free(vectors: DataFrame, fragments: DataFrame) -> DataFrame:
    """Vectors whose recorded version is the current one of their fragment."""
    return vectors.join(fragments.select("id", F.col("version_number").alias("content_version")), ["id", "content_version"])


def missing_vectors(fragments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Fragments without a vector."""
    return fragments.join(vectors.select("id"), "id", "left_anti")


def of_common_dimension(vectors: DataFrame, stored: DataFrame) -> DataFrame:
    """``vectors`` whose ``embedding`` has as many numbers as most of the stored ones."""
    size = F.size("embedding")
    by = stored.where("embedding is not null").groupBy(size.alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").head()
    return vectors.where(size == F.lit(by["dims"])) if by else vectors.limit(0)


@F.pandas_udf(BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit numbers one after another; a null stays null."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """The numbers of a blob; null where its bytes are no whole numbers."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))
