"""The queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phylomill import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle``: DuckDB SQL with table names in braces."""

    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = fx.duckdb(oracle)
        return f

    return put


def queries() -> dict[str, Query]:
    from phylomill.queries import clustering, matrices, support, trees  # noqa: F401

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL
