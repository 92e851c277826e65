"""Sessions and metrics over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def idle_sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """``key, started, ended, n``: runs of a key's events with no pause of ``gap`` or more.

    A key may hold a third of all events, so runs are first found within days, and then those that touch midnight from
    both sides are joined over the few rows that are left.
    """
    pause = F.expr(f"interval {gap}")
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).alias("t"))

    def runs(df: DataFrame, part: list[str], start: str, end: str, n) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(start, end)
        before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = (before.isNull() | (F.col(start) >= before + pause)).cast("int")
        marked = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return marked.groupBy(*part, "_run").agg(F.min(start).alias("started"), F.max(end).alias("ended"), n.alias("n")).drop("_run")

    days = runs(rows.withColumn("_day", F.to_date("t")).withColumn("u", F.col("t")), [key, "_day"], "t", "u", F.count(F.lit(1)))
    return runs(days.drop("_day"), [key], "started", "ended", F.sum("n"))


def metric_windows(events: DataFrame, at: str, window: str, *by: str) -> DataFrame:
    """``window_start, by..., n, total, mean``: tumbling windows of ``value``."""
    w = F.window(at, window)
    return events.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean")).select(F.col("window.start").alias("window_start"), *by, "n", "total", "mean")
