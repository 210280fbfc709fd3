"""Registry of the reference-side queries: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from memlake import queries_curation, queries_graph, queries_history, queries_listing, queries_maintenance, queries_reports, queries_retrieval, queries_text, queries_verify

PARTS = [queries_retrieval, queries_text, queries_graph, queries_history, queries_curation, queries_verify, queries_reports, queries_listing, queries_maintenance]
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
