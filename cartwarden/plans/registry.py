"""All queries of the commerce engine with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import admission_queries, arrival_queries, audit_queries, diagnostic_queries, fraud_queries, history_queries, ledger_queries, monitor_queries, outbox_queries, record_queries, report_queries, run_queries, series_queries

FLAGSHIP = "fraud_decisions"
_MODULES = (fraud_queries, record_queries, audit_queries, series_queries, report_queries, history_queries, admission_queries, outbox_queries, arrival_queries, ledger_queries, monitor_queries, run_queries, diagnostic_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
