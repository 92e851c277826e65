"""Long exact spans shared between records.

Method: compact windows. Every character k-gram of a text gets a hash; the Cartesian tree over these hashes says for
each position the widest range in which it holds the smallest hash. Cut to the least span length this is one row per
position that is the smallest of some window of that length: the anchor, with the range of all windows whose signature
(smallest hash) it is. Equal spans have equal hashes, hence equal smallest hashes at equal places, so one hash function
finds every verbatim span; more functions only serve inexact passages. Anchors are joined on the signature, and the
texts around equal anchors are compared, which gives exact intervals: ranges that agree in the signature and in the
fingerprint of the whole range (128 bits together) count as equal; of different ones up to PAIRWISE with one signature
are compared character by character, more of them by two fingerprints (128 bits) of each of their windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladoga.workspace import broadcast_within, cut

#: Long grams rarely stand in unrelated texts by chance, short ones give fewer anchors.
GRAM = 88
PIECE = 1_000_000
PAIRWISE = 48

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.full(n, _BASE, np.uint64)
            self.down = np.full(n, _INV, np.uint64)
            self.up[0] = self.down[0] = 1
            self.up = np.cumprod(self.up, dtype=np.uint64)
            self.down = np.cumprod(self.down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


def _prefix(codes: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.get(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(0x9E3779B9)) * up[: len(codes)], out=sums[1:])
    return sums, down


def _hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * down[start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    block[: len(x)] = x
    block = block.reshape(rows, w)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def _pieces(ids, texts, length: int) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Groups of (id, offset, code points) of at most about PIECE characters; long texts are cut with an overlap."""
    group: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for i, text in zip(ids, texts):
        if text is None or len(text) < length:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, max(1, len(codes) - length + 1), PIECE):
            part = codes[at : at + PIECE + length - 1]
            if size + len(part) > PIECE and group:
                yield group
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield group


def _anchors(length: int, gram: int):
    window = length - gram + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for pdf in batches:
            for group in _pieces(pdf["doc_id"].to_numpy(), pdf["text"], length):
                sizes = np.array([len(c) for _, _, c in group])
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                codes = np.concatenate([c for _, _, c in group])
                sums, down = _prefix(codes, powers)
                grams = _hash(sums, down, np.arange(len(codes) - gram + 1), np.arange(gram, len(codes) + 1))
                order = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
                at = (_sliding_min(order, window) & np.uint64((1 << 24) - 1)).astype(np.int64)
                piece = np.repeat(np.arange(len(group)), sizes)
                inside = piece[: len(at)] == piece[length - 1 : length - 1 + len(at)]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (piece[1 : len(at)] != piece[: len(at) - 1])
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(at)) - 1
                keep = inside[begin]
                begin, last = begin[keep], last[keep]
                end = last + length
                owner = piece[begin]
                ids = np.array([i for i, _, _ in group])
                offsets = np.array([o for _, o, _ in group])
                yield pd.DataFrame(
                    {
                        "h": grams[at[begin]].view(np.int64),
                        "fp": _hash(sums, down, begin, end).view(np.int64),
                        "lead": (at[begin] - begin).astype(np.int32),
                        "size": (end - begin).astype(np.int32),
                        "doc_id": ids[owner],
                        "start": (begin - first[owner] + offsets[owner]).astype(np.int32),
                    }
                )

    return run


def anchors(docs: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """``doc_id, text`` to one row per anchor: signature ``h``, fingerprint of its range, place of the range."""
    schema = "h long, fp long, lead int, size int, doc_id long, start int"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_anchors(length, gram), schema)


def _cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, rows in zip(pdf["text"], pdf["rows"]):
            for r in rows:
                out.append((r["h"], r["fp"], r["lead"], r["size"], r["dmin"], r["dmax"], r["kinds"], text[r["start"] : r["start"] + r["size"]]))
        yield pd.DataFrame(out, columns=["h", "fp", "lead", "size", "dmin", "dmax", "kinds", "range"])


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _compare(length: int):
    """Within one signature, every range against those of other documents; at most PAIRWISE ranges a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h, rows in zip(pdf["h"], pdf["rows"]):
                parts = [(r, r["range"][: r["lead"]][::-1], r["range"][r["lead"] :]) for r in rows]
                for i, (m, left, right) in enumerate(parts):
                    for n, left2, right2 in parts[:i]:
                        if m["dmin"] == m["dmax"] == n["dmin"] == n["dmax"]:
                            continue
                        a, b = _common(left, left2), _common(right, right2)
                        if a + b >= length:
                            for r in (m, n):
                                if r["dmin"] == r["dmax"]:
                                    out.append((h, r["fp"], r["lead"], r["size"], r["lead"] - a, r["lead"] + b))
            yield pd.DataFrame(out, columns=["h", "fp", "lead", "size", "low", "high"])

    return run


def _windows(length: int):
    """Each window of the least length in a range, by two fingerprints; for signatures with many ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for pdf in batches:
            for r in pdf.itertuples():
                codes = np.frombuffer(r.range.encode("utf-32-le", "surrogatepass"), np.uint32)
                low = np.arange(len(codes) - length + 1)
                one, two = _prefix(codes, powers), _prefix(codes + np.uint32(0x5BD1E995), powers)
                yield pd.DataFrame(
                    {
                        "h": r.h, "fp": r.fp, "lead": r.lead, "size": r.size, "dmin": r.dmin, "dmax": r.dmax,
                        "low": low.astype(np.int32),
                        "w1": _hash(*one, low, low + length).view(np.int64), "w2": _hash(*two, low, low + length).view(np.int64),
                    }
                )

    return run


KEY = ["h", "fp", "lead", "size"]


def shared_intervals(docs: DataFrame, length: int = 200, gram: int = GRAM) -> DataFrame:
    """``doc_id, start_pos, end_pos``: intervals, not yet merged, that stand verbatim in another document.

    Ranges that are equal as a whole are pre-aggregated into classes, so a group of copies of any size is one row per
    class before anything is compared. Only classes that share a signature with a different class have their text
    looked up: up to PAIRWISE of them are compared pair by pair, more by the fingerprints of all their windows, which is
    linear. Neither way drops a class.
    """
    every = cut(anchors(docs, length, gram))
    # a signature in one document only can't be shared; pre-aggregated, so a hot signature is a row a task
    hot = every.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h")
    near = cut(every.join(hot, "h", "left_semi"))
    classes = near.groupBy(*KEY).agg(F.min("doc_id").alias("dmin"), F.max("doc_id").alias("dmax"), F.min_by("start", "doc_id").alias("start"))
    by_sign = classes.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    known = cut(classes.join(by_sign, "h"))
    whole = known.where("dmin <> dmax").select(*KEY, F.lit(0).alias("low"), F.col("size").alias("high"))
    mixed = known.where("kinds > 1").select(F.col("dmin").alias("doc_id"), F.struct(*KEY, "dmin", "dmax", "start", "kinds").alias("r"))
    asked = mixed.groupBy("doc_id").agg(F.collect_list("r").alias("rows"))  # at most the anchors of one text
    schema = "h long, fp long, lead int, size int, dmin long, dmax long, kinds long, range string"
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    ranges = cut(texts.join(broadcast_within(cut(asked)), "doc_id").select("text", "rows").mapInPandas(_cut_out, schema))
    few = (
        ranges.where(F.col("kinds") <= PAIRWISE)
        .groupBy("h")
        .agg(F.collect_list(F.struct("fp", "lead", "size", "dmin", "dmax", "range")).alias("rows"))
        .mapInPandas(_compare(length), "h long, fp long, lead int, size int, low int, high int")
    )
    windows = cut(
        ranges.where(F.col("kinds") > PAIRWISE)
        .drop("kinds")
        .mapInPandas(_windows(length), "h long, fp long, lead int, size int, dmin long, dmax long, low int, w1 long, w2 long")
    )
    twice = windows.groupBy("h", "w1", "w2").agg(F.min("dmin").alias("lo"), F.max("dmax").alias("hi")).where("lo <> hi").select("h", "w1", "w2")
    many = windows.join(twice, ["h", "w1", "w2"]).select(*KEY, "low", (F.col("low") + length).alias("high"))
    found = whole.unionByName(few).unionByName(many).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("low", "high"))).alias("parts"))
    return near.join(found, KEY).select("doc_id", "start", F.explode("parts").alias("p")).select(
        "doc_id", (F.col("start") + F.col("p.low")).cast("long").alias("start_pos"), (F.col("start") + F.col("p.high")).cast("long").alias("end_pos")
    )


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Overlapping or touching intervals of a document become one."""
    w = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (
        intervals.withColumn("new", F.when(reach.isNull() | (F.col("start_pos") > reach), 1).otherwise(0))
        .withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "run")
        .agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
        .drop("run")
    )


def shared_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, start_pos, end_pos``: the longest runs of characters that lie in a stretch of at least ``length``
    characters standing verbatim in the text of another ``doc_id``.

    Null and short texts have none; rows repeated under one id count as one text; other columns are ignored.
    """
    return merge_intervals(shared_intervals(docs, length))


def shared_report(docs: DataFrame, length: int = 200) -> DataFrame:
    """Per document its characters, how many are shared, the share, and the number of runs; 0 where nothing is shared."""
    runs = shared_spans(docs, length).groupBy("doc_id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"), F.count(F.lit(1)).alias("n_runs"))
    sizes = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")).groupBy("doc_id").agg(F.max("chars").alias("chars"))
    shared = F.coalesce(F.col("shared_chars"), F.lit(0))
    return sizes.join(runs, "doc_id", "left").select(
        "doc_id", "chars", shared.alias("shared_chars"), F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        F.when(F.col("chars") > 0, shared / F.col("chars")).otherwise(F.lit(0.0)).alias("share"),
    )
