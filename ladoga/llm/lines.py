"""Lines repeated across the documents of one source.

Method: lines are brought to a normal form, dates, names and addresses in it are masked, and the masked lines of a source
are clustered by locality-sensitive hashing (min-hashes of five-word shingles, banded). In each bucket the most frequent
line leads and is compared with all others; of those whose shingles don't agree with a leader's to 0.8 or more, the most
frequent lead next, until none is left. Lines linked to leaders, through any of their buckets, are one cluster. Clusters
that stand in enough documents are repeated, and their lines are removed. Equal masked lines are one line from the start,
so a line that is frequent by itself always lies in a repeated cluster; where sameness is the equality of normal forms
(``exact=True``), each line's own count decides after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladoga.workspace import broadcast_within, cut, once

MIN_PAGES = 3
MIN_SHARE = 0.2
SHINGLE = 5
SIMILARITY = 0.8
BANDS = 6
ROWS = 3
#: So many lines of a bucket lead in one round at most.
LEADERS = 512


def normal_text(text: str | Column) -> Column:
    """Lower-cased, runs of blanks made one, ends of lines trimmed, runs of digits made ``0``; line breaks stay."""
    c = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    c = F.regexp_replace(c, "[ \\t\\u00A0]+", " ")
    c = F.trim(F.regexp_replace(c, " ?\\n ?", "\n"))
    return F.regexp_replace(c, "[0-9]+", "0")


def mask(line: Column) -> Column:
    """A normal line with dates, names with initials, mail addresses and hosts masked."""
    line = F.regexp_replace(line, "0[./-]0[./-]0( 0:0)?|0 (янв|фев|мар|апр|ма[йя]|июн|июл|авг|сен|окт|ноя|дек|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\\p{L}* 0", "\u0001")
    line = F.regexp_replace(line, "\\p{L}\\. ?\\p{L}\\. ?\\p{L}{2,}|\\p{L}{2,} \\p{L}\\. ?\\p{L}\\.", "\u0002")
    return F.regexp_replace(line, "[\\w.+-]+@[\\w.-]+|\\b[\\w-]+(\\.[\\w-]+)+\\b", "\u0003")


def _shingles(words: str) -> Column:
    """Hashes of the five-word shingles of a column of words; fewer words are one shingle."""
    n = F.size(words)
    return F.when(n <= SHINGLE, F.array(F.xxhash64(words))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))))


def _hashed(masked: DataFrame) -> DataFrame:
    """``masked`` with its ``id`` and, for each band, the hash of the band's min-hashes.

    The words are a column that several expressions refer to, and the min-hashes are folded in one pass over the
    shingles, so that neither is evaluated anew for every hash function. A line of fewer than five words is one shingle,
    equal only to itself, and needs no buckets.
    """
    start = F.array_repeat(F.lit((1 << 63) - 1), BANDS * ROWS)
    seeds = F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1))
    mins = F.aggregate(_shingles("words"), start, lambda acc, h: F.zip_with(acc, seeds, lambda m, j: F.least(m, F.xxhash64(h, j))))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64("source_id", b, F.slice("mins", b * ROWS + 1, ROWS)))
    hashed = masked.withColumn("words", F.split("masked", " ")).withColumn("mins", F.when(F.size("words") >= SHINGLE, mins))
    return hashed.select("source_id", "masked", "pages", "n", F.xxhash64("source_id", "masked").alias("id"), F.when(F.col("mins").isNotNull(), bands).alias("buckets"))


def _pages(pages: DataFrame) -> DataFrame:
    return once(pages.select("id", "source_id", F.coalesce("clean_text", F.lit("")).alias("clean_text")).where("source_id is not null"), "id")


def _frequent(pages: Column, n: Column, least: int, share: float) -> Column:
    return (pages >= least) & (pages >= n * share - 1e-9)


def line_counts(pages: DataFrame) -> DataFrame:
    """``source_id, line, pages, n``: distinct pages of the source with the line, and of the source."""
    lined = _pages(pages).select("source_id", F.array_distinct(F.split(normal_text("clean_text"), "\n")).alias("lines"))
    totals = lined.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    counts = lined.select("source_id", F.explode("lines").alias("line")).where("line <> ''").groupBy("source_id", "line").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(broadcast_within(cut(totals)), "source_id")


def _links(hashed: DataFrame) -> DataFrame:
    """``a, b``: leaders of buckets with the lines that agree with them.

    Buckets are worked on by ids alone, all at once in each round; shingles are looked up for the pairs to compare. The
    first round takes one leader from every bucket, each later one twice as many from those that have lines left, as far
    as LEADERS: most lines of a large bucket are near duplicates and go with the first, and lines unlike each other need
    few rounds.
    """
    each = hashed.where("buckets is not null").select("id", "pages", F.explode("buckets").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("bucket")
    members = cut(each.join(shared, "bucket"))
    texts = cut(members.select("id").distinct().join(hashed.select("id", "masked"), "id").withColumn("words", F.split("masked", " ")).select("id", _shingles("words").alias("shingles")))
    left, links, lead = members, None, 1
    while True:
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("pages"), "id"))
        leaders = left.withColumn("rank", rank).where(F.col("rank") <= lead).select("bucket", F.col("id").alias("leader"))
        pairs = members.join(leaders, "bucket").where("id <> leader").select("leader", "id").distinct()
        pairs = pairs.join(texts, "id").join(texts.select(F.col("id").alias("leader"), F.col("shingles").alias("others")), "leader")
        alike = F.size(F.array_intersect("shingles", "others")) >= SIMILARITY * F.size(F.array_union("shingles", "others"))
        found = cut(pairs.where(alike).select(F.col("leader").alias("a"), F.col("id").alias("b")))
        links = found if links is None else links.unionByName(found)
        taken = members.join(leaders, "bucket").join(found, (F.col("leader") == F.col("a")) & (F.col("id") == F.col("b"))).select("bucket", "id")
        taken = taken.unionByName(leaders.select("bucket", F.col("leader").alias("id")))
        left = cut(left.join(taken, ["bucket", "id"], "left_anti"))
        if left.isEmpty():
            return cut(links.distinct())
        lead = min(2 * lead, LEADERS)


def _clusters(links: DataFrame) -> DataFrame:
    """``id, cluster``: connected lines have the least id among them, found by passing it on along links."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("cluster")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("cluster").alias("near"))
        jump = label.select(F.col("id").alias("to"), F.col("cluster").alias("far"))
        new = label.join(near, F.col("id") == F.col("a")).withColumn("to", F.least("cluster", "near")).join(jump, "to", "left")
        new = cut(new.select("id", F.least("to", F.coalesce("far", "to")).alias("cluster"), (F.least("to", F.coalesce("far", "to")) < F.col("cluster")).alias("moved")))
        label = new.select("id", "cluster")
        if new.where("moved").isEmpty():
            return label


def candidate_clusters(counts: DataFrame, least: int = MIN_PAGES, share: float = MIN_SHARE) -> DataFrame:
    """``source_id, cluster, masked``: masked lines of near-duplicate clusters that may reach the least frequency: a
    cluster stands in no more documents than its lines together. A cluster is named by its most frequent line."""
    masked = counts.groupBy("source_id", mask(F.col("line")).alias("masked")).agg(F.sum("pages").alias("pages"), F.max("n").alias("n"))
    hashed = cut(_hashed(masked))
    of = hashed.select("source_id", "id", "masked", "pages", "n").join(_clusters(_links(hashed)), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    sums = of.groupBy("cluster").agg(F.sum("pages").alias("most"), F.max("n").alias("all"), F.max_by("masked", F.struct("pages", "masked")).alias("name"))
    sums = sums.where(_frequent(F.col("most"), F.col("all"), least, share)).select("cluster", "name")
    return of.join(broadcast_within(cut(sums)), "cluster").select("source_id", F.col("name").alias("cluster"), "masked")


def repeated_lines(pages: DataFrame, least: int = MIN_PAGES, share: float = MIN_SHARE, exact: bool = True) -> DataFrame:
    """``source_id, line, cluster, pages, n``: the normal forms repeated in each source.

    ``exact``: a line counts if it stands in at least ``least`` and at least ``share`` of the source's distinct pages by
    itself. Otherwise all lines of a cluster count if the cluster does. A source can have no more than 1/share times as
    many repeated lines as its pages have lines. Pages without a source, and empty lines, never count.
    """
    counts = cut(line_counts(pages))
    members = counts.withColumn("masked", mask(F.col("line"))).join(broadcast_within(cut(candidate_clusters(counts, least, share))), ["source_id", "masked"])
    if exact:
        return members.where(_frequent(F.col("pages"), F.col("n"), least, share)).select("source_id", "line", "cluster", "pages", "n")
    of = broadcast_within(cut(members.select("source_id", "cluster", "line", "n", F.xxhash64("line").alias("h"))))
    lined = _pages(pages).select("id", "source_id", F.explode(F.array_distinct(F.transform(F.split(normal_text("clean_text"), "\n"), lambda x: F.xxhash64(x)))).alias("h"))
    # a page counts once for a cluster however many of its lines it has
    hits = lined.join(of.select("source_id", "h", "cluster", "n"), ["source_id", "h"]).select("source_id", "cluster", "n", "id").distinct()
    sizes = hits.groupBy("source_id", "cluster").agg(F.count(F.lit(1)).alias("pages"), F.max("n").alias("n"))
    return of.drop("n", "h").join(cut(sizes.where(_frequent(F.col("pages"), F.col("n"), least, share))), ["source_id", "cluster"])


def _by_source(repeated: DataFrame) -> DataFrame:
    return repeated.groupBy("source_id").agg(F.collect_set(F.xxhash64("line")).alias("repeated"))


def _repeated_at(text: str) -> Column:
    lines = F.split(normal_text(text), "\n")
    flagged = F.transform(lines, lambda line, i: F.when((line != "") & F.array_contains("repeated", F.xxhash64(line)), i.cast("int")))
    return F.filter(flagged, lambda i: i.isNotNull())


def with_repeated(pages: DataFrame, fragments: DataFrame, repeated: DataFrame) -> DataFrame:
    """``tbl, rec_id, text, at``: each page and page fragment, once, with the numbers of its repeated lines.

    The lines of a source are one row, so texts are joined on the source once and not line by line; the side is
    broadcast while it is small, and beyond that Spark joins by shuffle and splits the hot sources.
    """
    by_source = broadcast_within(cut(_by_source(repeated)))
    pages = pages.select("id", "source_id", "clean_text")
    texts = once(pages, "id").select(F.lit("pages").alias("tbl"), F.col("id").alias("rec_id"), "source_id", F.col("clean_text").alias("text"))
    owner = pages.select(F.col("id").alias("page_id"), "source_id").dropDuplicates(["page_id"])
    cuts = once(fragments.where("page_id is not null").select("id", "page_id", "text"), "id").select(F.lit("fragments").alias("tbl"), F.col("id").alias("rec_id"), "page_id", "text")
    cuts = cuts.join(owner, "page_id", "left").select("tbl", "rec_id", "source_id", "text")
    return texts.unionByName(cuts).join(by_source, "source_id", "left").withColumn("at", F.coalesce(_repeated_at("text"), F.array().cast("array<int>"))).drop("repeated")


def repeated_positions(pages: DataFrame, fragments: DataFrame, **kw) -> DataFrame:
    """``tbl, rec_id, line_no`` of every occurrence of a line repeated by itself; repeated rows count once."""
    rows = with_repeated(pages, fragments, repeated_lines(pages, **kw))
    return rows.select("tbl", "rec_id", F.explode("at").alias("line_no"))


def without_repeated(pages: DataFrame, fragments: DataFrame, **kw) -> DataFrame:
    """``tbl, rec_id, text, removed``: texts without the lines of repeated clusters, near duplicates included. A null text
    stays null; repeated rows give one row."""
    rows = with_repeated(pages, fragments, repeated_lines(pages, exact=False, **kw))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("at", i.cast("int")))
    return rows.select("tbl", "rec_id", F.array_join(kept, "\n").alias("text"), F.size("at").alias("removed"))
