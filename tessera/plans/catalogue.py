"""All queries of the core and their SQL."""

from __future__ import annotations

from tessera.plans import bindings, bindings_sql, evidence, evidence_sql, problems, problems_sql, streams

_MODULES = ((problems, problems_sql), (bindings, bindings_sql), (evidence, evidence_sql), (streams, streams))


def queries():
    return {name: f for q, _ in _MODULES for name, f in q.QUERIES.items()}


def oracle_sql():
    return {name: sql for _, s in _MODULES for name, sql in s.ORACLES.items()}
