"""Cutting texts into fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladoga.functions.text import CODE, YEARS, content_hash, found


def fixed_windows(texts: DataFrame, size: int = 800, overlap: int = 100, least: int = 50) -> DataFrame:
    """``id, chunk_index, start, text``: windows of ``size`` characters that overlap; the last one ends with the text, and
    windows of fewer than ``least`` trimmed characters are left out."""
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    kept = F.filter(starts, lambda s: (s == 0) | (s + overlap < n))
    rows = texts.where(n > 0).select("id", "text", F.posexplode(kept).alias("chunk_index", "start"))
    rows = rows.select("id", "chunk_index", "start", F.col("text").substr(F.col("start") + 1, F.lit(size)).alias("text"))
    return rows.where(F.length(F.trim("text")) >= least)


def paragraphs(texts: DataFrame, least: int = 50, most: int = 1000, part: int = 800) -> DataFrame:
    """``id, chunk_index, text``: paragraphs between empty lines; one of fewer than ``least`` characters goes with the
    next one, as far as there is a next one, and one of more than ``most`` is cut at blanks in parts of at most ``part``."""
    parts = F.filter(F.transform(F.split("text", "\\n[ \\t]*\\n+"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(acc, p):
        now = F.when(acc["held"] == "", p).otherwise(F.concat(acc["held"], F.lit("\n"), p))
        short = F.length(now) < least
        return F.struct(
            F.when(short, acc["done"]).otherwise(F.concat(acc["done"], F.array(now))).alias("done"),
            F.when(short, now).otherwise(F.lit("")).alias("held"),
        )

    folded = F.aggregate(parts, start, step, lambda a: F.when(a["held"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["held"]))))
    pieces = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{part - 1}}}[ \\n]|.{{1,{part}}}"), F.lit(0)), lambda x: F.trim(x))
    bounded = F.flatten(F.transform(folded, lambda p: F.when(F.length(p) > most, pieces(p)).otherwise(F.array(p))))
    return texts.where("text is not null").select("id", F.posexplode(bounded).alias("chunk_index", "text"))


def shortened(text: Column, most: int) -> Column:
    """A text of more than ``most`` characters cut at the last blank before them, with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_extract(text, f"(?s)^(.{{0,{most - 1}}})[ \\n]", 1), F.lit("…")))


def lines_under_head(texts: DataFrame, n: int) -> DataFrame:
    """``id, chunk_index, lines, text``: the lines after the first in parts of ``n``, the first line over each part."""
    x = F.split("text", "\\n")
    parts = F.when(F.size(x) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1)), F.lit(n)), lambda i: F.slice(x, i + 1, n)))
    rows = texts.where("text is not null").select("id", F.get(x, F.lit(0)).alias("head"), F.posexplode(parts).alias("chunk_index", "part"))
    return rows.select("id", "chunk_index", F.size("part").alias("lines"), F.concat("head", F.lit("\n"), F.array_join("part", "\n")).alias("text"))


def records(lines: DataFrame, header: str) -> DataFrame:
    """``id, record, line_no, line``: each line with the number of the header line it belongs to; lines before the first
    header belong to record 0."""
    each = lines.where("text is not null").select("id", F.posexplode(F.split("text", "\\n")).alias("line_no", "line"))
    upto = F.sum(F.col("line").rlike(header).cast("int")).over(Window.partitionBy("id").orderBy("line_no"))
    return each.select("id", upto.cast("int").alias("record"), "line_no", "line")


def section_fragments(sections: DataFrame, size: int = 600, overlap: int = 150, least: int = 50) -> DataFrame:
    """Sections ``id, position, title, parent_titles, text`` to fragments with what is known of their place.

    A section of at most ``size`` characters is one fragment; a longer one is cut in overlapping windows, so none is
    longer. ``chunk_index`` counts the fragments of a page.
    """
    keyed = sections.where("text <> ''").select(F.struct("id", "position").alias("k"), "title", "parent_titles", "text")
    cut = fixed_windows(keyed.select(F.col("k").alias("id"), "text"), size, overlap, least).select(F.col("id").alias("k"), F.col("chunk_index").alias("part"), "text")
    rows = cut.join(keyed.drop("text"), "k").select("k.id", "k.position", "part", "title", "parent_titles", "text")
    order = Window.partitionBy("id").orderBy("position", "part")
    code = F.get(found(F.concat_ws(" ", "parent_titles", "text"), CODE), F.lit(0))
    return rows.select("id", (F.row_number().over(order) - 1).alias("chunk_index"), "title", "parent_titles", "text", content_hash("text").alias("text_hash"), code.alias("code"), F.get(found("text", YEARS), F.lit(0)).alias("year"))
