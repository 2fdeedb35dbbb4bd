"""Queries by name, each with its SQL form where it has one."""

from __future__ import annotations

from collections.abc import Callable

from mnemo.plans import fixtures as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str = "", sql: str | None = None, recursive: bool = False) -> Callable:
    """Register a function of (spark, sf_dir); ``tables`` are the derived ones that ``sql`` reads."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = T.with_tables(tables, sql, recursive) if tables else sql
        return f

    return add
