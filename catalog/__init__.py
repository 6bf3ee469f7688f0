"""Registered queries: each pairs a DataFrame function with the DuckDB SQL that checks it (where SQL can)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("rows", "windows", "missing", "specs", "preparation", "validation", "storage", "selection", "reshaping")

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for module in MODULES:
        import_module(f"{__name__}.{module}")
