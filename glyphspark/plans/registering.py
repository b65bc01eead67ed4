"""Collects the queries of a module."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """(queries, oracles, decorator): the decorator registers a function of (spark, sf_dir) under its name with its SQL."""
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None) -> Callable:
        def put(function: Callable) -> Callable:
            queries[function.__name__] = function
            if sql:
                oracles[function.__name__] = sql
            return function

        return put

    return queries, oracles, query
