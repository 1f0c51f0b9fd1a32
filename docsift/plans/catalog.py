"""All registered queries but those of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsift.plans import index_queries, ingest_queries, retrieval_queries, service_queries, source_queries, state_queries, text_queries

_MODULES = (retrieval_queries, text_queries, state_queries, service_queries, ingest_queries, index_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
