"""Keeping tables current: versions, merges, latest rows, and whether cached results still hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladoga.functions.text import normalize


def merge_by_hash(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """``key, status``: whether each incoming row is ``new``, ``updated`` or ``unchanged``, and current ones not seen again
    ``missing``; with the version number that follows. Both sides have one row a key, ``content`` and ``version``."""
    a = current.select(key, F.col(content).alias("old"), F.col("version").alias("v"))
    b = incoming.select(key, F.col(content).alias("new"))
    status = (
        F.when(F.col("v").isNull(), "new").when(F.col("seen").isNull(), "missing").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    )
    version = F.coalesce("v", F.lit(0)) + status.isin("new", "updated").cast("int")
    return a.join(b.withColumn("seen", F.lit(1)), key, "full").select(key, status.alias("status"), version.cast("int").alias("version"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. The limit of one a group is applied before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def version_history(df: DataFrame, key: str, at: str, content: str) -> DataFrame:
    """Rows of each key in time with their version: it goes up by one where the content changes."""
    w = Window.partitionBy(key).orderBy(at, "id")
    changed = F.coalesce((F.lag(content).over(w) != F.col(content)).cast("int"), F.lit(1))
    return df.withColumn("changed", changed).withColumn("version", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("changed")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``incoming`` in place of the rows of ``current`` with the same keys."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def insert_missing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``incoming`` whose keys it doesn't have."""
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti"))


def dependency_state(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """``entry_id, n, missing, stale, valid``: an entry holds if it has dependencies and all exist at the recorded version.

    ``recorded``: entry_id, id, version; ``current``: id, version.
    """
    now = current.select("id", F.col("version").alias("now"))
    return (
        recorded.join(now, "id", "left")
        .groupBy("entry_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("now").isNull().cast("int")).alias("missing"),
            F.sum((F.col("now") != F.col("version")).cast("int")).alias("stale"),
            F.bool_and(F.coalesce(F.col("now") == F.col("version"), F.lit(False))).alias("valid"),
        )
        .withColumn("stale", F.coalesce("stale", F.lit(0)))
    )


def numbered(rows: DataFrame, order: Column, start: int = 0) -> DataFrame:
    """``rows`` with ``id`` from ``start + 1`` on in the order of a hexadecimal hash: numbered within its first three
    digits, and these by how many rows have lesser ones, so no task sorts all rows."""
    rows = rows.withColumn("_hash", order).withColumn("_head", F.substring("_hash", 1, 3))
    sizes = rows.groupBy("_head").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("n")  # at most 4,096 rows
    own = F.row_number().over(Window.partitionBy("_head").orderBy("_hash"))
    return rows.withColumn("_own", own).join(F.broadcast(offsets), "_head").withColumn("id", F.col("_own") + F.col("_before") + F.lit(start)).drop("_hash", "_head", "_own", "_before")


def cache_key(question: str, *parts: str) -> Column:
    """The hash of a question's normal form and of all else its answer depends on; nulls count as empty."""
    return F.sha2(F.concat_ws("|", normalize(question), *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def replaced(rows: DataFrame, key: str, at: str, content: str) -> DataFrame:
    """Rows whose content the next row of the same key changes, with ``replaced_at``."""
    w = Window.partitionBy(key).orderBy(at, "id")
    return rows.withColumn("_next", F.lead(content).over(w)).withColumn("replaced_at", F.lead(at).over(w)).where(F.col("_next") != F.col(content)).drop("_next")
