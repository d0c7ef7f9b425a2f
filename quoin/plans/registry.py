"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from quoin.runtime import arrow_limits, ship

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(spark, sf_dir):
            ship(spark)
            arrow_limits(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
