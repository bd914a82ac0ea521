"""Queries of the library's own operators and the DuckDB SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "hybrid_search"
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL where there is one."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from corpusloom import plans

    plans.load()


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
