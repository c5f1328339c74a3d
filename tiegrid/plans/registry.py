"""The registry of queries: each has a name, a function, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from tiegrid.plans.views import oracle

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function (spark, sf_dir) -> DataFrame under its name."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = oracle(sql)
        return f

    return register
