"""All queries of the core and their SQL."""

from __future__ import annotations

from repspark.plans import after_queries, annotate_queries, check_queries, domain_queries, scale_queries, sequence_queries, source_queries

FLAGSHIP = "clonotype_freq_by_sample"
_PARTS = (scale_queries, sequence_queries, domain_queries, annotate_queries, after_queries, source_queries, check_queries)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
