"""Queries of the click-analytics engine: name -> function, and the same queries in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

FLAGSHIP = "flagship"

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) and the SQL that must give the same rows."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _load() -> None:
    from lodemark.plans import (  # noqa: F401  importing registers
        aggregate_queries,
        depth_queries,
        join_queries,
        model_queries,
        projection_queries,
        report_queries,
        sampling_queries,
        site_queries,
        window_queries,
    )


def all_queries() -> dict[str, Callable]:
    _load()
    return QUERIES


def all_sql() -> dict[str, str]:
    _load()
    return SQL
