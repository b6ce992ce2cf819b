"""All registered queries of the document-evidence engine, and the SQL that states the same."""

from __future__ import annotations

from importlib import import_module

_MODULES: tuple[str, ...] = ("vectors", "catalog", "graph", "search", "notify", "state", "evaluate", "manifest", "texts", "ingest", "portal", "measure", "stores", "walk")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(import_module(f"tessel.plans.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE")
