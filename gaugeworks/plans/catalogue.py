"""All queries of the core and their SQL."""

from . import analysis_queries, corpus_queries, extraction_queries, problem_queries

_MODULES = [problem_queries, analysis_queries, corpus_queries, extraction_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
