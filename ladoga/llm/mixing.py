"""Mixing sources to target weights.

Method: iterative proportional fitting. The tokens of each mix's sources are counted in cells of source, language and
topic. The cells are raked to the target shares of the sources and to the languages' and topics' own shares, each cell
at most as often as its source may be repeated, the sources last so that their shares hold. A document is then taken as
often as its cell's weight says, with the fraction as the probability of one more time: the documents of a source are
ordered by a hash over that probability, and the first that fill the source's target are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladoga.llm.tokens import VOCABULARY, token_counts
from ladoga.workspace import broadcast_within, cut

ROUNDS = 60
#: Documents of a source are ordered within steps of their rank: so many at least, and so many that each has few documents.
STEPS = 1024
PER_STEP = 20_000


def rake(cells: pd.DataFrame, shares: dict[str, float]) -> np.ndarray:
    """Tokens to take from each cell. ``cells``: source, lang, topic, tokens, cap (times a cell may be taken).

    The total is the largest at which every source that has tokens reaches its share.
    """
    tokens = cells["tokens"].to_numpy(float)
    most = tokens * cells["cap"].to_numpy(float)
    source = cells["source"].to_numpy()
    limits = [most[source == s].sum() / w for s, w in shares.items() if w > 0 and most[source == s].sum() > 0]
    if not limits:
        return np.zeros(len(cells))
    total = min(limits)
    want = {s: w * total for s, w in shares.items()}
    weight = tokens.copy()
    got = sum(want[s] for s in set(source) if s in want)
    margins = []
    for dim in ("lang", "topic"):
        own = cells.groupby(dim)["tokens"].sum()
        margins.append((cells[dim].to_numpy(), {k: got * v / own.sum() for k, v in own.items()}))

    def fit(at: np.ndarray, goal: float) -> None:
        """Scale the cells to their goal, none beyond its cap."""
        now = weight[at].sum()
        if now >= goal > 0:
            weight[at] *= goal / now
            return
        for _ in range(len(tokens) + 1):
            free = at & (weight < most * (1 - 1e-12))
            rest = goal - weight[at & ~free].sum()
            if rest <= 0 or not free.any():
                return
            start = weight[free] if weight[free].sum() > 0 else tokens[free]
            scaled = start * rest / start.sum()
            weight[free] = np.minimum(scaled, most[free])
            if not (scaled > most[free]).any():
                return

    for _ in range(ROUNDS):
        before = weight.copy()
        for keys, goals in margins:
            for k, goal in goals.items():
                fit(keys == k, goal)
        for s in set(source):
            fit(source == s, want.get(s, 0.0))
        if np.allclose(before, weight, rtol=1e-7, atol=1e-6):
            break
    return weight


def _rake(pdf: pd.DataFrame) -> pd.DataFrame:
    shares = dict(zip(pdf["source"], pdf["target_share"]))
    pdf = pdf.sort_values(["source", "lang", "topic"]).reset_index(drop=True)
    weight = rake(pdf, shares)
    rate = np.divide(weight, pdf["tokens"], out=np.zeros(len(pdf)), where=pdf["tokens"] > 0)
    rate = np.where(np.abs(rate - np.round(rate)) < 1e-9, np.round(rate), rate)
    pdf["rate"] = np.minimum(rate, pdf["cap"])
    steps = np.maximum(STEPS, np.ceil(pdf.groupby("source")["n"].transform("sum") / PER_STEP)).astype("int64")
    return pdf[["mix_name", "source", "lang", "topic", "rate", "tokens"]].assign(wanted=weight, steps=steps)


def choose(docs: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``mix_name, source, doc_id, tokens, repeats``: the documents of each mix with how often each is taken, at least once.

    ``docs``: doc_id, source, lang, topic, text; a null language or topic is one of its own, a null source is none. A
    source that is listed but has no tokens gets none, the others keep their proportions. No document is taken more than
    its source's ``max_repeats`` times. The cells of one mix are as many as its sources times languages times topics.
    """
    sized = docs.select(F.col("doc_id").cast("long"), "source", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("topic", F.lit("")).alias("topic"), "text")
    sized = cut(token_counts(sized, ["doc_id", "source", "lang", "topic"], path).dropDuplicates(["doc_id"])).where("tokens > 0")
    goals = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("cap")).where("cap > 0 and target_share > 0")
    cells = sized.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    rates = cut(
        cells.join(broadcast_within(goals), "source")
        .groupBy("mix_name")
        .applyInPandas(_rake, "mix_name string, source string, lang string, topic string, rate double, tokens long, wanted double, steps long")
    )
    base, part = F.floor("rate"), F.col("rate") - F.floor("rate")
    chance = (F.xxhash64("mix_name", "doc_id").bitwiseAND(F.lit((1 << 53) - 1)) + 1) / F.lit(float(1 << 53))
    rows = sized.join(broadcast_within(rates.drop("tokens", "wanted")), ["source", "lang", "topic"])
    rows = rows.select("mix_name", "source", "doc_id", "tokens", base.cast("int").alias("base"), F.when(part > 1e-9, chance / part).alias("rank"), "steps")
    # what the whole repeats leave of each source's goal
    left = rates.groupBy("mix_name", "source").agg(F.sum(F.col("wanted") - base * F.col("tokens")).alias("left"))
    # the last one taken is near rank 1; steps are equal up to 2 and grow with the rank beyond, so that none holds more
    # than about the same share of a source, however few of its documents are wanted
    step = F.when(F.col("rank") < 2, F.floor(F.col("rank") * F.col("steps"))).otherwise(2 * F.col("steps") + F.floor(F.log(F.col("rank") / 2) * F.col("steps") / 2))
    rows = rows.withColumn("step", F.when(F.col("rank").isNotNull(), step))
    # running sums of ordered documents: over steps first, and within a step only for those in it
    steps = rows.where("step is not null").groupBy("mix_name", "source", "step").agg(F.sum("tokens").alias("sum"))
    w = Window.partitionBy("mix_name", "source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum("sum").over(w), F.lit(0))).join(left, ["mix_name", "source"])
    steps = broadcast_within(cut(steps.drop("sum")))
    order = Window.partitionBy("mix_name", "source", "step").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.where("step is not null").join(steps, ["mix_name", "source", "step"]).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    # the last one is taken if that comes closer to the goal than leaving it
    extra = (F.col("upto") - F.col("tokens") / 2 <= F.col("left")).cast("int")
    whole = rows.where("step is null").select("mix_name", "source", "doc_id", "tokens", F.col("base").alias("repeats"))
    return whole.unionByName(ranked.select("mix_name", "source", "doc_id", "tokens", (F.col("base") + extra).alias("repeats"))).where("repeats > 0")


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix and source: target and actual share of the mix's tokens, tokens, documents, most repeats of a document."""
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    goals = targets.groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return goals.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_repeats"]).withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))


def invariants(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """Per mix: sources listed, documents taken more often than their source allows, taken twice over, or of sources that
    are not listed. All but the first are 0 for every input."""
    goals = targets.groupBy("mix_name", "source").agg(F.max("max_repeats").alias("max_repeats"))
    rows = chosen.groupBy("mix_name", "source", "doc_id").agg(F.sum("repeats").alias("repeats"), F.count(F.lit(1)).alias("rows")).join(goals, ["mix_name", "source"], "left")
    of = rows.groupBy("mix_name").agg(
        F.sum((F.col("repeats") > F.col("max_repeats")).cast("long")).alias("beyond_cap"), F.sum((F.col("rows") > 1).cast("long")).alias("twice"), F.sum(F.col("max_repeats").isNull().cast("long")).alias("unlisted"),
    )
    listed = goals.groupBy("mix_name").agg(F.count(F.lit(1)).alias("sources"))
    return listed.join(of, "mix_name", "left").select("mix_name", "sources", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("beyond_cap", "twice", "unlisted")])
