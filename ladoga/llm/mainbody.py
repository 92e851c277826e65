"""The main body of web pages, without what is set around it.

Method: composite text density over the tree of elements. The density of a node is its link-adjusted characters per tag:
characters per tag times a logarithm of the ratios of characters to link characters and of tags to link tags, to a base
that grows with the links of the node against those of the page. Densities of direct children are summed; the node with
the largest sum is the body, and so is every node whose density reaches the least density on the path from the body to
the root. Density alone takes a long legal notice for a body and a body made of links for a menu, so characters are
weighted by statistics over all pages of a site: a line that stands on many pages of the source weighs nothing; one in a
container whose signature (the path of elements with attributes) holds repeated lines on other pages, and no headings,
weighs less; what precedes the page's heading, or follows a line that opens lists of links on other pages, weighs little.

Lines are the leaves of the tree. Where repeated lines stand between others in one container, each run of lines between
them is a node; so are the runs of layouts in which every line is a container of its own, and of pages without markup.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladoga.llm.encoding import Scorer, model, repair
from ladoga.llm.markup import read, squeeze
from ladoga.workspace import broadcast_within, cut, once

#: A line is repeated in a source if it stands on this many pages and this share of them.
MIN_PAGES = 3
MIN_SHARE = 0.045
#: A repeated line is none of furniture if it stands this often in the container with the heading; one that no container
#: of a heading was seen with is furniture if this share of the source's pages has it.
IN_BODY = 0.2
STRONG = 0.12
#: A layout has no tree if this share of its lines is alone in its container.
FLAT = 0.7
#: Weight of what precedes the heading, and of what follows a line that opens lists of links.
ASIDE = 0.02

_DIGITS = re.compile("[0-9]+")

LAYOUT = (
    "id long, source_id long, line_no array<int>, line array<long>, chars array<int>, row array<boolean>, heading int, "
    "block array<int>, links array<int>, tags array<int>, parent array<int>, path array<string>, same long"
)


def line_key(line: str) -> int:
    return xxhash.xxh64_intdigest(_DIGITS.sub("0", line.lower())) - (1 << 63)


def aligned(keys: list[str], lines: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places at which two lists of lines agree, in order. Where they part, the nearer of the next place of the
    one line in the other list and of the other line in the one list goes on, however far it is."""
    there: dict[str, list[int]] = {}
    for j in range(len(keys) - 1, -1, -1):
        there.setdefault(keys[j], []).append(j)
    here: dict[str, list[int]] = {}
    for k in range(len(lines) - 1, -1, -1):
        here.setdefault(lines[k], []).append(k)

    def after(places: list[int] | None, at: int) -> int | None:
        """The first place at or after ``at``; earlier ones are never asked for again."""
        while places and places[-1] < at:
            places.pop()
        return places[-1] if places else None

    k = j = 0
    while k < len(lines) and j < len(keys):
        if lines[k] == keys[j]:
            yield k, j
            k, j = k + 1, j + 1
            continue
        ahead, back = after(there.get(lines[k]), j), after(here.get(keys[j]), k)
        if ahead is not None and (back is None or ahead - j <= back - k):
            j = ahead
        else:
            k += 1


def _layout(title: str | None, markup: str | None, text: str, scorer: Scorer) -> tuple:
    """The lines of one page: number, key, characters, whether a table row; and container, link characters, tags.

    A line that was decoded wrongly has the key of the line it was, so that it counts with its like on other pages.
    """
    numbers, lines = [], []
    meant = repair(text, scorer)[1].split("\n")
    own = text.split("\n")
    if len(meant) != len(own):
        meant = own
    for i, line in enumerate(own):
        if plain := squeeze(line):
            numbers.append(i)
            lines.append((plain, "\t" in line.strip()))
    page = read(markup) if markup else None
    block = links = tags = parent = path = None
    heading = -1
    names = {squeeze(t).lower() for t in (title, page and page.title) if t and t.strip()}
    if page:
        block, links, tags, last = [-1] * len(lines), [0] * len(lines), [1] * len(lines), 0
        for k, j in aligned([squeeze(x.text).lower() for x in page.lines], [plain.lower() for plain, _ in lines]):
            x = page.lines[j]
            block[k], links[k], tags[k] = x.block, x.links, x.tags
            if heading < 0 and (x.tag == "h1" or lines[k][0].lower() in names):
                heading = k
        for k, b in enumerate(block):
            last = block[k] = last if b < 0 else b
        parent, path = page.parents, page.paths
    if names:
        named = next((k for k, (plain, _) in enumerate(lines) if plain.lower() in names), -1)
        heading = named if named >= 0 else heading
    return numbers, [line_key(squeeze(meant[i]) or p) for i, (p, _) in zip(numbers, lines)], [len(p) for p, _ in lines], [r for _, r in lines], heading, block, links, tags, parent, path


def _layouts(words: "object"):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in LAYOUT.split(", ")]
        scorer = Scorer(words.value)
        for pdf in batches:
            for part in range(0, len(pdf), 500):
                rows = [(r.id, r.source_id, *_layout(r.title, r.raw_html, r.clean_text, scorer), xxhash.xxh64_intdigest(r.clean_text) - (1 << 63)) for r in pdf.iloc[part : part + 500].itertuples()]
                yield pd.DataFrame(rows, columns=names)

    return run


def layouts(pages: DataFrame) -> DataFrame:
    """One row per distinct page with its lines and containers, texts left behind. A page without text has no lines."""
    words = pages.sparkSession.sparkContext.broadcast(model(pages.select(F.lit("").alias("lang"), F.col("clean_text").alias("text"))))
    cols = [F.col("id").cast("long"), F.coalesce(F.col("source_id").cast("long"), F.lit(-1)).alias("source_id"), "title", "raw_html", F.coalesce("clean_text", F.lit("")).alias("clean_text")]
    return pages.select(*cols).mapInPandas(_layouts(words), LAYOUT).dropDuplicates(["id"])


def _flagged(pages: DataFrame, often: DataFrame) -> DataFrame:
    flags = F.transform("line", lambda x, i: F.coalesce(F.array_contains("often", x), F.lit(False)) & ~F.element_at("row", i + 1))
    return pages.join(often, "source_id", "left").withColumn("repeated", flags).drop("often")


def repeated_keys(pages: DataFrame) -> DataFrame:
    """``source_id, line, share``: keys of the lines repeated in each source, at most 1/MIN_SHARE times a page's lines."""
    # pages of one text count once: the body of a page with many copies would look repeated
    pages = cut(once(pages.select("source_id", "same", "line"), "source_id", "same"))
    totals = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    counts = pages.select("source_id", F.explode(F.array_distinct("line")).alias("line")).groupBy("source_id", "line").agg(F.count(F.lit(1)).alias("pages"))
    hot = counts.where(F.col("pages") >= MIN_PAGES).join(broadcast_within(totals), "source_id")
    return hot.select("source_id", "line", (F.col("pages") / F.col("n")).alias("share")).where(F.col("share") >= MIN_SHARE)


def furniture_keys(pages: DataFrame, often: DataFrame) -> DataFrame:
    """``source_id, often``: the repeated lines of each source that are furniture.

    Over all sources with containers, a line that stands in the container of the heading often enough is a standing phrase
    of bodies. A line that no such page has says nothing, and is furniture only if it is very frequent in its source.
    """
    at = F.transform("line", lambda x, i: F.struct(x.alias("line"), (F.get("block", i) == F.get("block", F.col("heading"))).cast("int").alias("inside")))
    once = pages.where("path is not null and heading >= 0 and size(array_distinct(block)) > 1").where(F.size(F.array_distinct("block")) < FLAT * F.size(F.filter("row", lambda r: ~r)))
    inside = once.select(F.explode(at).alias("x")).groupBy("x.line").agg(F.avg("x.inside").alias("inside"), F.count(F.lit(1)).alias("seen")).where("seen >= 3")
    furniture = (F.col("inside") < IN_BODY) | (F.col("inside").isNull() & (F.col("share") >= STRONG))
    return often.join(inside, "line", "left").where(furniture).groupBy("source_id").agg(F.collect_set("line").alias("often"))


def signature_weights(flagged: DataFrame) -> DataFrame:
    """``source_id, weights``: for each signature of a source the share of its pages whose heading it holds, and of its
    lines that are repeated."""
    lines = F.arrays_zip("block", "repeated")
    at = F.transform(lines, lambda x, i: F.struct(F.element_at("path", x["block"] + 1).alias("path"), x["repeated"].cast("int").alias("repeated"), (i == F.col("heading")).cast("int").alias("headed")))
    per_page = (
        flagged.where("path is not null")
        .select("id", "source_id", F.explode(at).alias("x"))
        .groupBy("source_id", "id", "x.path")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("x.repeated").alias("repeated"), F.max("x.headed").alias("headed"))
    )
    stats = per_page.groupBy("source_id", "path").agg(F.avg("headed").alias("headed"), (F.sum("repeated") / F.sum("n")).alias("repeated"), F.count(F.lit(1)).alias("pages"))
    # signatures on one page say nothing about the site, and there may be as many as pages
    return stats.where("pages >= 3").groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("path", F.struct("headed", "repeated")))).alias("weights"))


def sidebar_heads(flagged: DataFrame) -> DataFrame:
    """Keys of repeated lines that open a container whose other lines are not repeated, as over lists of links."""
    cells = F.arrays_zip("block", "repeated", "line")
    opens = F.filter(
        F.transform(cells, lambda x, i: F.when(
            (i > 0) & (F.get("block", i - 1) != x["block"]) & x["repeated"] & (F.get("block", i + 1) == x["block"]) & ~F.get("repeated", i + 1), x["line"]
        )),
        lambda x: x.isNotNull(),
    )
    repeated = F.aggregate("repeated", F.lit(0), lambda n, x: n + x.cast("int"))
    return flagged.where("path is not null").where(repeated > 0).select(F.explode(opens).alias("line")).groupBy("line").count().where("count >= 3").select("line")


def density(chars: float, links: float, tags: float, link_tags: float, page_links: float) -> float:
    """Composite text density of a node: link-adjusted characters per tag.

    ``page_links`` is the share of link characters on the page. A node of links only keeps a little density.
    """
    if chars <= 0:
        return 0.0
    links, tags, link_tags = max(links, 1.0), max(tags, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - links, 1.0) * links + page_links * chars + math.e) + 1.0
    return chars / tags * math.log(max(chars / links * tags / link_tags, 1.0) + 1.0) / math.log(base)


def regions(repeated: list[bool], rows: list[bool], block: list[int], parent: list[int], heading: int) -> tuple[list[int], list[int]]:
    """Of each line the node it is a leaf of, and of each node its parent: the containers, and runs of lines in them."""
    block, up = list(block), list(parent)
    alone: dict[int, int] = {}
    for k, b in enumerate(block):
        if not rows[k]:
            alone[b] = alone.get(b, 0) + 1
    if sum(alone.values()) >= 8 and sum(n == 1 for n in alone.values()) >= FLAT * sum(alone.values()):
        block = [up[b] if alone.get(b) == 1 and up[b] >= 0 else b for b in block]
    mixed = {b for k, b in enumerate(block) if repeated[k] or 0 < k == heading and block[k - 1] == b}
    out, run = [], -1
    for k, b in enumerate(block):
        if b in mixed and not repeated[k]:
            if run < 0 or up[run] != b or k == heading:
                up.append(b)
                run = len(up) - 1
            out.append(run)
        else:
            out.append(b)
            run = -1
    return out, up


def line_weights(repeated, heading, region, block, path, weights, opens) -> list[float]:
    """What a character of each line weighs, by the statistics of the site."""
    out, first = [], {}
    for k, r in enumerate(region):
        w = 0.0 if repeated[k] else ASIDE if k < heading else 1.0
        at = first.setdefault(r, k) - 1
        if at >= 0 and repeated[at] and k != heading and opens(at):
            w *= ASIDE
        if w and path is not None and (of := weights.get(path[block[k]])):
            w *= min(1.0, of["headed"] + (1 - of["repeated"]) ** 2)
        out.append(w)
    return out


def body_lines(chars, repeated, rows, heading, block, links, tags, parent, path, weights, opens) -> list[bool]:
    """For each line whether it belongs to the body: the heading, and lines that weigh in nodes of the body.

    ``weights``: by signature the share of pages whose heading it holds and of its lines that are repeated. ``opens``:
    whether a line opens lists of links on other pages.
    """
    n = len(chars)
    if n == 0:
        return []
    block, parent = (block, parent) if block is not None else ([0] * n, [-1])
    links, tags = links if links is not None else [0] * n, tags if tags is not None else [1] * n
    region, up = regions(repeated, rows, block, parent, heading)
    weight = line_weights(repeated, heading, region, block, path, weights, opens)
    leaves = [(c * w, min(link, c) * w, t, link > 0) for c, link, t, w in zip(chars, links, tags, weight)]
    of_chars, of_links, of_tags, of_link_tags = [0.0] * len(up), [0.0] * len(up), [0] * len(up), [0] * len(up)
    for r, (c, link, t, linked) in zip(region, leaves):
        of_chars[r] += c
        of_links[r] += link
        of_tags[r] += t
        of_link_tags[r] += linked
    for r in range(len(up) - 1, 0, -1):  # a node comes after its parent
        for of in (of_chars, of_links, of_tags, of_link_tags):
            of[up[r]] += of[r]
    page_links = of_links[0] / of_chars[0] if of_chars[0] else 0.0
    dense = [density(*x, page_links) for x in zip(of_chars, of_links, of_tags, of_link_tags)]
    sums = [0.0] * len(up)
    for r in range(1, len(up)):
        sums[up[r]] += dense[r]
    for r, leaf in zip(region, leaves):
        if leaf[0]:
            sums[r] += density(*leaf, page_links)
    # the page itself is a body only where nothing is below it
    best = max(range(1, len(up)), key=lambda r: (sums[r], r)) if any(sums[1:]) else 0
    least, r = dense[best], best
    while r >= 0:
        least, r = min(least, dense[r]), up[r]
    low = {up[r] for r in range(1, len(up)) if dense[r] < least}
    kept = {r for r in range(1, len(up)) if dense[r] >= least and r not in low}
    within = {best}
    for r in range(best + 1, len(up)):
        if up[r] in within:
            within.add(r)
    kept |= within
    return [k == heading or w > 0 and r in kept for k, (r, w) in enumerate(zip(region, weight))]


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            heads = set() if r.heads is None else set(r.heads.tolist())
            weights = r.weights if isinstance(r.weights, dict) else dict(r.weights) if r.weights is not None else {}
            chars, repeated, rows, line = (x.tolist() for x in (r.chars, r.repeated, r.row, r.line))
            tree = [None if x is None else x.tolist() for x in (r.block, r.links, r.tags, r.parent, r.path)]
            body = body_lines(chars, repeated, rows, r.heading, *tree, weights, lambda k, line=line, h=heads: line[k] in h)
            out.append((r.id, [n for n, b in zip(r.line_no, body) if b], [n for n, b in zip(r.line_no, body) if not b]))
        yield pd.DataFrame(out, columns=["page_id", "body", "around"])


def main_bodies(pages: DataFrame) -> DataFrame:
    """``page_id, body, around``: numbers of the non-empty lines of ``clean_text`` that belong to the body, and of the others.

    A page without text has none of either. Repeated rows count once. Statistics cover all pages; a source's repeated
    lines and signatures are one row each, broadcast while they are few.
    """
    laid = cut(layouts(pages))
    often = cut(furniture_keys(laid, repeated_keys(laid)))
    flagged = _flagged(laid, broadcast_within(often))
    weights = broadcast_within(cut(signature_weights(flagged)))
    heads = often.select("source_id", F.explode("often").alias("line")).join(sidebar_heads(flagged), "line")
    heads = broadcast_within(cut(heads.groupBy("source_id").agg(F.collect_set("line").alias("heads"))))
    ready = flagged.join(weights, "source_id", "left").join(heads, "source_id", "left")
    cols = ["id", "line_no", "line", "chars", "repeated", "row", "heading", "block", "links", "tags", "parent", "path", "weights", "heads"]
    return ready.select(*cols).mapInPandas(_bodies, "page_id long, body array<int>, around array<int>")


def _pick(at: str) -> Column:
    return F.array_join(F.transform(at, lambda i: F.trim(F.get(F.split("clean_text", "\n"), i))), "\n")


def bodies_of(pages: DataFrame) -> DataFrame:
    """``page_id, body_text``: the body of each page, one line per line."""
    lines = main_bodies(pages).select("page_id", "body")
    return pages.select(F.col("id").alias("page_id"), "clean_text").join(lines, "page_id").select("page_id", _pick("body").alias("body_text")).dropDuplicates(["page_id"])
