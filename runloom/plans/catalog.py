"""The registry of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runloom.plans.view_sql import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, survey_id: str, sql: str | None = None, views: str = "", recursive: bool = False):
    """Registers a query; ``views`` names the derived tables its SQL reads."""

    def add(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        SURVEY_IDS[name] = survey_id
        if sql is not None:
            SQL[name] = with_views(sql, *views.split(), recursive=recursive)
        return fn

    return add
