"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval_queries", "ingest_queries", "evidence_queries", "evaluation_queries", "report_queries", "workbench_queries", "trace_queries")


def _modules():
    return [import_module(f"{__package__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
