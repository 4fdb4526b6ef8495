"""Queries of this subpackage."""

from __future__ import annotations

from feedwake.llm import (
    alignment_queries,
    bpe_queries,
    ctph_queries,
    factors_queries,
    fixity_queries,
    importance_queries,
    mixing_queries,
    quality_queries,
    simhash_queries,
    substring_queries,
    suffixes_queries,
    toxicity_queries,
    urls_queries,
)

MODULES = [toxicity_queries, bpe_queries, quality_queries, urls_queries, fixity_queries, simhash_queries, substring_queries, suffixes_queries, ctph_queries, mixing_queries, alignment_queries, importance_queries, factors_queries]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
