"""The decorator that registers a query with the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans.registry import ORACLE_SQL, QUERIES
from tessera.plans.views import with_views


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = with_views(sql)
        return function

    return add
