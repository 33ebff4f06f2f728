"""All registered queries of the library, without the text-corpus ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chartloom.plans.views import Views, with_views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: Views that single modules of queries add to the shared ones.
EXTRA_VIEWS: dict[str, str] = {}
#: Views that single queries see under a name, whatever other modules call so.
_OWN_VIEWS: dict[str, dict[str, str]] = {}


def query(sql: str | None, name: str | None = None, views: dict[str, str] | None = None):
    """Register a function of the views as a query, with its SQL over tables and fv_ views; those of `views` are this query's own."""

    def add(f: Callable[[Views], DataFrame]):
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"{key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
            _OWN_VIEWS[key] = views or {}
        return f

    return add


def _load() -> None:
    from chartloom.plans import analytics, catalogue, ingest, resolution, text  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: with_views(s, EXTRA_VIEWS | _OWN_VIEWS[k]) for k, s in _SQL.items()}
