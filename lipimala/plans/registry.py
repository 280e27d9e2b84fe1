"""All queries of the core, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lipimala.plans import core_problems, curate_queries, measure_queries, page_queries, text_queries

_MODULES = [core_problems, text_queries, measure_queries, curate_queries, page_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
