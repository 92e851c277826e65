"""Structure of HTML pages: sections under their headings, tables, links."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIP = {"script", "style", "nav", "footer", "header", "noscript", "template"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}


class _Parser(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.sections, self.tables, self.links = 0, [], [], []
        self.stack: list[tuple[int, str]] = []
        self.heading: list[str] | None = None
        self.level = 0
        self.table: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.skip += 1
        elif tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v]
        elif tag in HEADINGS and not self.skip:
            self.heading, self.level = [], HEADINGS[tag]
        elif tag == "table" and not self.skip:
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table is not None:
            if not self.table:
                self.table.append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in HEADINGS and self.heading is not None:
            title = " ".join("".join(self.heading).split())
            self.heading = None
            # an open heading ends at one of its own level or above; levels left out are not filled in
            self.stack = [x for x in self.stack if x[0] < self.level] + [(self.level, title)]
            self.sections.append((self.level, title, [t for _, t in self.stack], []))
        elif tag in ("td", "th") and self.cell is not None:
            self.table[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.table is not None:
            rows = [r for r in self.table if any(r)]
            if rows:
                self.tables.append(rows)
            self.table = self.cell = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.heading is not None:
            self.heading.append(data)
        elif self.cell is not None:
            self.cell.append(data)
        elif self.table is None and self.sections and data.strip():
            self.sections[-1][3].append(" ".join(data.split()))


def parse(source: str, base: str = "") -> tuple[list, list, list]:
    """Sections ``(level, title, titles above and its own, text)``, tables as rows of cells, and absolute links. Text before
    the first heading is left out, text of tables is in the tables only."""
    p = _Parser()
    p.feed(source)
    p.close()
    links = list(dict.fromkeys(urljoin(base, x) if base else x for x in p.links if not re.match(r"(?i)(#|javascript:|mailto:|tel:)", x)))
    return [(lv, t, above, " ".join(x)) for lv, t, above, x in p.sections], p.tables, links


SCHEMA = (
    "id long, sections array<struct<level: int, title: string, parent_titles: array<string>, text: string>>, "
    "tables array<array<array<string>>>, links array<string>"
)


def _structures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, url, source in zip(pdf["id"], pdf["url"], pdf["html"]):
            sections, tables, links = parse(source, url or "") if source else ([], [], [])
            out.append((i, [dict(zip(("level", "title", "parent_titles", "text"), s)) for s in sections], tables, links))
        yield pd.DataFrame(out, columns=["id", "sections", "tables", "links"])


def structures(pages: DataFrame) -> DataFrame:
    """``id, url, html`` to ``id, sections, tables, links``; a page without markup has empty ones."""
    return pages.select(F.col("id").cast("long"), "url", "html").mapInPandas(_structures, SCHEMA)


def sections(parsed: DataFrame) -> DataFrame:
    """One row per section: ``id, position, level, title, parent_titles, text``."""
    return parsed.select("id", F.posexplode("sections").alias("position", "s")).select("id", "position", "s.*")


def table_lines(parsed: DataFrame, keep_empty: bool = True) -> DataFrame:
    """One row per table row: ``id, table_no, row_no, line``, each cell with the column's head before it. Without
    ``keep_empty`` empty cells are dropped first, so that those after them move to the column before."""
    t = parsed.select("id", F.posexplode("tables").alias("table_no", "rows")).withColumn("head", F.get("rows", F.lit(0)))
    r = t.select("id", "table_no", "head", F.posexplode("rows").alias("row_no", "cells")).where("row_no > 0")
    if not keep_empty:
        full = lambda c: F.filter(c, lambda x: F.coalesce(x, F.lit("")) != "")
        r = r.withColumn("head", full("head")).withColumn("cells", full("cells"))
    cells = F.transform(F.arrays_zip(F.col("head").alias("h"), F.col("cells").alias("c")), lambda x: F.concat_ws(": ", F.nullif(x["h"], F.lit("")), F.nullif(x["c"], F.lit(""))))
    return r.select("id", "table_no", "row_no", F.array_join(F.filter(cells, lambda x: x != ""), "; ").alias("line"))


def unescape(text: str) -> str:
    return html.unescape(text)
