"""Names, queries and SQL of the survey operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Views, with_views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None, recursive: bool = False):
    """Register a query on the views, with the SQL that gives the same rows."""

    def add(f: Callable[[Views], DataFrame]):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = with_views(sql, recursive)
        return f

    return add


def _load() -> None:
    from . import catalog_aggregates, catalog_boxes, catalog_contacts, catalog_graphs, catalog_joins, catalog_more, catalog_rasters, catalog_rules, catalog_sources, catalog_streams, catalog_windows  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
