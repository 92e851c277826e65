"""Reading raw files: bodies of unknown encoding, and the text of simple PDF files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)


def decode(body: bytes | None, content_type: str | None = None) -> str | None:
    """The text of a body: by the charset of its header or of its first kilobytes, as UTF-8 if that is valid, else as
    windows-1251."""
    if body is None:
        return None
    named = _CHARSET.search((content_type or "").encode()) or _CHARSET.search(body[:2048])
    for name in ([named.group(1).decode()] if named else []) + ["utf-8"]:
        try:
            return body.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
    return body.decode("cp1251", "replace")


_STRING = r"\(((?:\\.|[^\\()])*)\)"
_SHOWN = re.compile(_STRING + r"\s*(?:Tj|'|\")|\[((?:\((?:\\.|[^\\()])*\)|[-+\d.\s])*)\]\s*TJ")
_PART = re.compile(rf"{_STRING}|([-+]?[\d.]+)")


def pdf_text(body: bytes | None) -> str | None:
    """Strings shown within text blocks; if that gives next to nothing, the longest printable runs."""
    if body is None:
        return None
    raw = body.decode("latin-1")
    shown = []
    for block in re.findall(r"BT(.*?)ET", raw, re.S):
        for one, array in _SHOWN.findall(block):
            # the strings of an array are parts of words, moved by the numbers between; a large step back is a blank
            parts = [(s if s or not n else " " if float(n) < -200 else "") for s, n in _PART.findall(array)] if array else [one]
            shown.append("".join(parts))
    text = " ".join(re.sub(r"\\([()\\])", r"\1", s) for s in shown)
    if len(text) < 50:
        runs = re.findall(r"[A-Za-zА-Яа-яЁё0-9 .,:;()\-]{5,}", body.decode("utf-8", "ignore"))
        text = max((text, " ".join(r.strip() for r in runs if r.strip())), key=len)
    return " ".join(text.split())


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["text"] = [pdf_text(b) if p.lower().endswith(".pdf") else decode(b) for p, b in zip(pdf["path"], pdf["content"])]
        yield pdf[["path", "hash", "size", "text"]]


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, hash, size, text`` of all files below ``path``: the hash is that of the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), "content")
    return rows.mapInPandas(_texts, "path string, hash string, size long, text string")
