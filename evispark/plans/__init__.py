"""The registered queries over the driver's tables, and DuckDB SQL with the same rows.

Orders stand for tasks, customers for source rows, line items for child tasks and list items, parts for roles, suppliers
for companies, events for the event log, documents for evidence texts and pages for captured artifacts.
"""

from __future__ import annotations

from . import acceptance, audit, documents, events, export, folds, joins, library, queue, reports, results, rollups, routing, structured, text, topics

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queue, rollups, joins, text, documents, events, results, acceptance, audit, export, routing, library, structured, folds, topics, reports):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
