"""The registered queries of the core library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ladoga.plans import answers, corpus, dialogs, relevance, retrieval, state

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _module in (corpus, retrieval, dialogs, state, answers, relevance):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL

FLAGSHIP: Query = QUERIES["hybrid_pipeline"]
