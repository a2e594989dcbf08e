"""Where queries and their SQL are put down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from foliograph.plans.views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQLS: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQLS[name or f.__name__] = sql
        return f

    return put
