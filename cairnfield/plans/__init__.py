"""Registered queries of the engine's operators and their DuckDB oracles."""

from __future__ import annotations


def _modules():
    from cairnfield.plans import queries_cases, queries_content, queries_hosts, queries_rows, queries_sources

    return [queries_hosts, queries_rows, queries_cases, queries_content, queries_sources]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLES.items()}
