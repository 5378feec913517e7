"""All queries of the freight library, and an independent SQL statement for each that SQL can express."""

from __future__ import annotations

from haulspark.plans import desk_queries, dispatch_queries, feedback_queries, kpi_queries, list_queries, live_queries, load_queries, matrix_queries, memory_queries, notice_queries, office_queries, place_queries, reading_queries, report_queries, sequence_queries, street_queries

_MODULES = (kpi_queries, list_queries, sequence_queries, office_queries, desk_queries, report_queries, place_queries, dispatch_queries, live_queries, load_queries, street_queries, memory_queries, matrix_queries, feedback_queries, notice_queries, reading_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
