"""The queries of this library by name, and the SQL that states each one's result."""

from __future__ import annotations

from loomstone.plans import durable_queries, enrichment_queries, language_queries, lexical_queries, memory_queries, store_queries, support_queries, vector_queries

_MODULES = [vector_queries, lexical_queries, memory_queries, support_queries, store_queries, enrichment_queries, durable_queries, language_queries]
FLAGSHIP = "hier_search"
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
