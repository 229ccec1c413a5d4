"""The query catalogue: every query of the library by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Adds a query to the catalogue, with its SQL where there is one."""

    def add(query: Query) -> Query:
        key = name or query.__name__
        _QUERIES[key] = query
        if sql:
            _SQL[key] = sql
        return query

    return add


#: Modules whose queries make up the catalogue; each registers its own when imported.
MODULES = ("calibration_queries", "trace_queries", "multivariate_queries", "structure_queries", "review_queries", "crystal_queries", "long_queries")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["calibration_fit"](spark, sf_dir)


def _load() -> None:
    for module in MODULES:
        import_module(f"{__package__}.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
