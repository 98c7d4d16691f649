"""All queries of the library and the DuckDB SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its oracle if SQL can express it."""

    def add(f: Query) -> Query:
        if name in _found:
            raise ValueError(f"{name} is registered twice")
        _found[name] = (f, oracle)
        return f

    return add


def _load() -> None:
    """Imports the modules that register queries."""
    from tidemark.plans import economy_queries, extract_queries, history_queries, line_queries, report_queries, session_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return {name: f for name, (f, _) in _found.items()}


def oracles() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _found.items() if sql is not None}
