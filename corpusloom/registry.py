"""Queries by name, and the SQL that DuckDB runs to the same result."""

from __future__ import annotations

from .plans import language_queries, stream_queries, text_queries

_MODULES = (text_queries, language_queries, stream_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "spell_check"
