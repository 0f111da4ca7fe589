"""Every registered query of the library and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import event_queries, flow_queries, gate_queries, scan_queries, table_queries, text_queries

MODULES = (event_queries, text_queries, table_queries, scan_queries, gate_queries, flow_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
