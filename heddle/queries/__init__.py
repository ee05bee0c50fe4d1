"""Registered queries: name to (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalar", "tables", "lineage", "streams", "formats")


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all modules."""
    found, sql = {}, {}
    for name in MODULES:
        for key, (fn, text) in import_module(f"{__name__}.{name}").QUERIES.items():
            found[key] = fn
            if text is not None:
                sql[key] = text
    return found, sql
