"""All named queries of the market engine."""

from __future__ import annotations

from . import abstain_queries, engine_queries, factor_queries, indicator_queries, learning_queries, signal_queries, stream_queries, study_queries, table_queries

MODULES = [indicator_queries, study_queries, factor_queries, signal_queries, engine_queries, learning_queries, table_queries, abstain_queries, stream_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
