"""Queries by name, and SQL for the same rows."""

from __future__ import annotations

from aerolith.plans.views import WITH, Views

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Registers a function of the views as a query, with SQL (after the views' own, or alone if it begins with --) that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql if sql.startswith("--") else WITH + sql
        return f

    return add
