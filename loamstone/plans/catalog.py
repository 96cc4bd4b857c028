"""All queries of the core, by name, and their SQL."""

from loamstone.plans import document_queries, hierarchy_queries, pipeline_queries, search_queries, text_queries

_MODULES = (hierarchy_queries, search_queries, text_queries, document_queries, pipeline_queries)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
