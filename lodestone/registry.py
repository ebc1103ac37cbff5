"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.views import CTES

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir); sql is a SELECT, or further CTEs and a SELECT after a comma."""

    def add(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = f"WITH RECURSIVE {CTES}{sql}" if sql.lstrip().startswith(",") else f"WITH RECURSIVE {CTES} {sql}"
        return f

    return add
