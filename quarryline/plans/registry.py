"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalogs, documents, graphs, indexes, retrieval, streams, texts

MODULES = (retrieval, texts, documents, graphs, catalogs, streams, indexes)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in MODULES for k, s in m.SQL.items()}
