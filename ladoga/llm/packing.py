"""Filling containers of fixed capacity.

Method: exact-complement hashing. Only lengths matter, and there are no more lengths than the capacity, so the plan is
made from counts by length: for each length, longest first, the gap it leaves is looked up among single lengths, pair
sums and triple sums that are still available, and all containers that can be filled exactly that way are taken at once.
What is left goes best-fit, longest first, over counts of gaps. Each specification is planned in a task of its own, from
no more rows than its capacity; every step of a plan uses up a length, so the plan is as bounded. It says which ordinal
numbers of each length go to which containers; documents get their numbers in parallel and look up their container.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladoga.llm.tokens import VOCABULARY, token_counts
from ladoga.workspace import cut

#: Documents of one length are numbered in so many groups at least, and so many that each has about this many rows.
SALT, PER_SALT = 64, 100_000
_SHIFT = 44


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Contents of containers with how many containers have them. ``counts``: items by length, 1 to ``capacity``."""
    have = np.zeros(capacity + 1, np.int64)
    for size, n in counts.items():
        have[size] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...]) -> bool:
        need = Counter(items)
        n = min(int(have[size]) // k for size, k in need.items())
        if n:
            for size, k in need.items():
                have[size] -= n * k
            out.append((items, n))
        return n > 0

    def pairs(total: int) -> np.ndarray:
        """The larger parts of all pairs of available lengths with this sum, largest first."""
        if total < 2:
            return np.empty(0, np.int64)
        big = np.arange(min(total - 1, capacity), (total - 1) // 2, -1)
        return big[(have[big] > 0) & (have[total - big] > 0)]

    if have[capacity]:
        take((capacity,))
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if have[a] and have[gap]:
            take((a, gap))
    for a in range(capacity - 1, 0, -1):
        if have[a]:
            for b in pairs(capacity - a):
                if not have[a]:
                    break
                take((a, int(b), int(capacity - a - b)))
    # sums of pairs; as nothing is ever added, a sum once found without a pair stays without
    some = (have > 0).astype(np.float32)
    n = 1 << (2 * capacity + 1).bit_length()
    sums = np.rint(np.fft.irfft(np.fft.rfft(some, n) ** 2, n)[: capacity + 1]) > 0
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        while have[a] and gap > 2:
            third = np.flatnonzero((have[1:gap] > 0) & sums[gap - 1 : 0 : -1])
            if not len(third):
                break
            b = int(third[-1]) + 1
            ok = pairs(gap - b)
            if not len(ok):
                sums[gap - b] = False
            elif not any(take((a, b, int(c), int(gap - b - c))) for c in ok):
                break  # the lengths repeat within the container and are too few
    # best fit, longest first: groups of equal containers by the gap they have left
    open_: dict[int, list[list]] = {}
    gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, items: tuple[int, ...], n: int) -> None:
        if gap == 0:
            out.append((items, n))
        else:
            open_.setdefault(gap, []).append([items, n])
            gaps[gap] = True

    for size in range(capacity, 0, -1):
        left = int(have[size])
        while left:
            fit = np.flatnonzero(gaps[size:])
            if len(fit):
                gap = size + int(fit[0])
                group = open_[gap][-1]
                n = min(left, group[1])
                group[1] -= n
                if not group[1]:
                    open_[gap].pop()
                    gaps[gap] = bool(open_[gap])
                put(gap - size, (*group[0], size), n)
                left -= n
            else:
                each = capacity // size
                n = left // each
                if n:
                    put(capacity - each * size, (size,) * each, n)
                    left -= n * each
                if left:
                    put(capacity - left * size, (size,) * left, 1)
                    left = 0
    out += [(tuple(items), n) for groups in open_.values() for items, n in groups]
    return out


SLOTS = "spec_name string, key long, first long, each long, containers long"


def _slots(pdf: pd.DataFrame) -> pd.DataFrame:
    """For the ordinal numbers of each length of one specification: key of the first number, first container, items a
    container. ``pdf``: spec_name, capacity_tokens, tokens, n."""
    counts = {int(t): int(n) for t, n in zip(pdf["tokens"], pdf["n"]) if t}
    used: dict[int, int] = {}
    rows, at = [], 0
    for items, n in plan(counts, int(pdf["capacity_tokens"].iloc[0])):
        for size, r in Counter(items).items():
            start = used.get(size, 0)
            rows.append(((size << _SHIFT) + start, at, r))
            used[size] = start + r * n
        at += n
    return pd.DataFrame(rows, columns=["key", "first", "each"]).assign(spec_name=pdf["spec_name"].iloc[0], containers=at)[["spec_name", "key", "first", "each", "containers"]]


def _assign(tables):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            for spec, rows in pdf.groupby("spec_name").indices.items():
                keys, first, each, total = tables.value[spec]
                part = pdf.iloc[rows]
                size, number = part["tokens"].to_numpy(np.int64), part["number"].to_numpy(np.int64)
                key = (size << _SHIFT) + number
                at = np.searchsorted(keys, key, "right") - 1
                bins = first[at] + (key - keys[at]) // each[at] if len(keys) else np.zeros(len(part), np.int64)
                out[rows] = np.where(size > 0, bins, number % max(1, total))
            yield pdf.assign(container_id=out)[["spec_name", "container_id", "doc_id", "part", "start_token", "tokens"]]

    return run


def items(docs: DataFrame, specs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``spec_name, capacity_tokens, doc_id, part, start_token, tokens``: a document is one item, or, if it exceeds the
    capacity, as few as possible, all full but the last."""
    sized = cut(token_counts(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], path).dropDuplicates(["doc_id"]))
    c = F.col("capacity_tokens")
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / c) - 1, F.lit(0)).cast("int")))
    # the specifications are a few rows given by hand: each document is repeated for each of them
    of = F.explode(F.array(*[F.struct(F.lit(r["spec_name"]).alias("spec_name"), F.lit(int(r["capacity_tokens"])).alias("capacity_tokens")) for r in specs.select("spec_name", "capacity_tokens").distinct().collect()]))
    each = sized.select("doc_id", "tokens", of.alias("s")).select("s.*", "doc_id", "tokens").select("*", parts.alias("part"))
    return each.select("spec_name", "capacity_tokens", "doc_id", "part", (F.col("part") * c).cast("long").alias("start_token"), F.least(c.cast("long"), F.col("tokens") - F.col("part") * c).alias("tokens"))


def pack(docs: DataFrame, specs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``spec_name, container_id, doc_id, part, start_token, tokens``: each document, or each part of one that exceeds
    the capacity, in one container.

    The rows of a plan that reach the driver are bounded by the capacity. A text without tokens
    takes no room; such texts are spread over the containers. Repeated rows count once.
    """
    every = cut(items(docs, specs, path))
    salts = max(SALT, every.count() // PER_SALT)
    every = every.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)))
    by = cut(every.groupBy("spec_name", "capacity_tokens", "tokens", "salt").agg(F.count(F.lit(1)).alias("n")))
    sizes = by.groupBy("spec_name", "capacity_tokens", "tokens").agg(F.sum("n").alias("n"))
    slots = sizes.groupBy("spec_name", "capacity_tokens").applyInPandas(_slots, SLOTS).toPandas()
    tables = {r["spec_name"]: (np.zeros(0, np.int64),) * 3 + (0,) for r in specs.select("spec_name").distinct().collect()}
    for spec, part in slots.sort_values(["spec_name", "key"]).groupby("spec_name"):
        tables[spec] = (*(part[c].to_numpy(np.int64) for c in ("key", "first", "each")), int(part["containers"].iloc[0]))
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    w = Window.partitionBy("spec_name", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by.select("spec_name", "tokens", "salt", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("spec_name", "tokens", "salt").orderBy("doc_id", "part")) - 1
    numbered = every.withColumn("within", within).join(offsets, ["spec_name", "tokens", "salt"])
    rows = numbered.select("spec_name", "doc_id", "part", "start_token", "tokens", (F.col("within") + F.col("offset")).cast("long").alias("number"))
    return rows.mapInPandas(_assign(sent), "spec_name string, container_id long, doc_id long, part int, start_token long, tokens long")


def report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per specification: containers, tokens, the share of room used, the fewest containers possible, overfull ones, and
    documents split."""
    per = packed.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("tokens"))
    split = packed.where("part > 0").groupBy("spec_name").agg(F.count_distinct("doc_id").alias("split_documents"))
    c = F.col("capacity_tokens")
    return (
        per.join(specs, "spec_name")
        .groupBy("spec_name", "capacity_tokens")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum((F.col("tokens") > c).cast("int")).alias("overfull"), F.sum((F.col("tokens") == c).cast("int")).alias("full"))
        .withColumn("used", F.col("tokens") / (F.col("containers") * c))
        .withColumn("fewest", F.ceil(F.col("tokens") / c))
        .join(split, "spec_name", "left")
        .fillna(0, ["split_documents"])
    )


def invariants(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per specification: documents packed, overfull containers, parts that don't follow one another, documents split that
    would have fitted. All but the first are 0 for every input."""
    per = packed.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("load")).join(specs, "spec_name")
    over = per.groupBy("spec_name").agg(F.sum((F.col("load") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    docs = packed.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("parts"), F.max(F.col("start_token") + F.col("tokens")).alias("end")).join(specs, "spec_name")
    of = docs.groupBy("spec_name").agg(
        F.count(F.lit(1)).alias("documents"), F.sum((F.col("end") != F.col("tokens")).cast("long")).alias("torn"),
        F.sum(((F.col("parts") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).cast("long")).alias("split_in_vain"),
    )
    return over.join(of, "spec_name").select("spec_name", "documents", "overfull", "torn", "split_in_vain")
