"""Streaming jobs: dialog sessions as state, pages merged as they arrive, metrics in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ladoga.operators.changes import latest, merge_by_hash

#: A session without turns for so long is closed.
IDLE_MS = 30 * 60 * 1000
#: Turns kept of a session.
KEPT = 5
#: Batches between snapshots of the merged pages.
COMPACT = 20

SESSION = "session_id string, started timestamp, ended timestamp, turns long, topic string, last_messages array<string>, closed boolean"
STATE = "started long, ended long, turns long, topic string, last_messages array<string>"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    def row(s: tuple, closed: bool) -> pd.DataFrame:
        started, ended = (pd.Timestamp(x, unit="ms") for x in s[:2])
        return pd.DataFrame([(key[0], started, ended, s[2], s[3], list(s[4]), closed)], columns=["session_id", "started", "ended", "turns", "topic", "last_messages", "closed"])

    if state.hasTimedOut:
        last = state.get
        state.remove()
        yield row(last, True)
        return
    s = state.get if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["turn_ts", "turn_id"])
    for r in rows.itertuples():
        at = int(r.turn_ts.timestamp() * 1000)
        if s is not None and at - s[1] >= IDLE_MS:
            yield row(s, True)
            s = None
        if s is None:
            s = (at, at, 0, None, [])
        topic = r.topic if isinstance(r.topic, str) else s[3]
        s = (s[0], max(s[1], at), s[2] + 1, topic, [*s[4], r.user_message if isinstance(r.user_message, str) else ""][-KEPT:])
    state.update(s)
    state.setTimeoutTimestamp(max(s[1] + IDLE_MS, state.getCurrentWatermarkMs() + 1))


def dialog_sessions(turns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of turns (session_id, turn_id, turn_ts, topic, user_message) to its closed sessions: a session closes when
    the watermark is 30 minutes past its last turn, or when a later turn comes after such a pause. A turn without a topic
    keeps the session's."""
    return (
        turns.withWatermark("turn_ts", late)
        .groupBy("session_id")
        .applyInPandasWithState(_fold, SESSION, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def metric_stream(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of a stream of events (ts, event_type, value), each given out once it can't change."""
    w = F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """``url, content_hash, version, batch`` of a folder; none where nothing was stored yet. Other errors are errors."""
    try:
        rows = spark.read.parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "url string, content_hash string, version int, batch long")
    return rows.select("url", "content_hash", "version", F.col("batch").cast("long").alias("batch"))


def merge_pages(store: str, compact: int = COMPACT):
    """For ``foreachBatch``: keeps the newest row of each address below ``store``, one folder a batch, and a log of what
    each batch changed. A batch that is run again writes its folder again. Every ``compact`` batches the whole state is
    written once more as a snapshot, so a batch reads one snapshot and fewer than ``compact`` folders."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = latest(batch, ["url"], F.desc("fetched_at"), F.desc("id")).select("url", "content_hash", "fetched_at", "id")
        since = number - number % compact  # the snapshot holds all batches before it
        snapshot = _stored(spark, f"{store}/snapshots/{since}")
        current = latest(snapshot.unionByName(_stored(spark, f"{store}/state").where((F.col("batch") >= since) & (F.col("batch") < number))), ["url"], F.desc("batch"))
        merged = merge_by_hash(current, newest, "url", "content_hash").where("status in ('new', 'updated', 'unchanged')")
        rows = newest.join(merged, "url").select("url", "content_hash", "version", "status")
        rows.write.mode("overwrite").parquet(f"{store}/state/batch={number}")
        if (number + 1) % compact == 0:
            both = current.unionByName(rows.select("url", "content_hash", "version", F.lit(number).cast("long").alias("batch")))
            latest(both, ["url"], F.desc("batch")).write.mode("overwrite").parquet(f"{store}/snapshots/{number + 1}")

    return run
