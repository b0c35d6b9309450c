"""All registered queries of the core library."""

from __future__ import annotations

from turnstone.plans import control_queries, dataset_queries, interval_queries, stream_queries, transcript_queries

_MODULES = [transcript_queries, dataset_queries, interval_queries, stream_queries, control_queries]
FLAGSHIP = "quality_by_language"

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
