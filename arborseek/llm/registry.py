"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from arborseek.llm import distinctive_queries, encoding_queries, frequency_queries, leakage_queries, markup_queries, splitting_queries, stuffing_queries

MODULES = (frequency_queries, distinctive_queries, splitting_queries, markup_queries, encoding_queries, leakage_queries, stuffing_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
