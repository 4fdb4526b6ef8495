"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedwake.harness import broad_queries, candidate_queries, closure_queries, event_queries, replay_queries, store_queries

MODULES = [closure_queries, replay_queries, broad_queries, candidate_queries, event_queries, store_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
