"""Query catalogues: each module has QUERIES (name -> callable) and SQL (name -> the same result as ANSI SQL)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("integrity", "impact", "relations", "pipelines", "derived", "assembly")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"wakegraph.queries.{name}"), attribute)
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict[str, str]:
    return _merged("SQL")
