"""The query registry: name -> plan, name -> SQL twin."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None) -> Callable:
    """Register a plan under its function's name, with the SQL that gives the same rows."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


from . import series_queries, shape_queries, source_queries  # noqa: E402,F401  they register themselves
