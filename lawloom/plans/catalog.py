"""The registered queries of the core and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lawloom.operators.timestamps import p1_found

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, root) under its own name, with its SQL twin if there is one."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


QUERIES["p1_found"] = p1_found

from lawloom.plans import articles, facts, mining, retrieval, scalars, state  # noqa: E402, F401

FLAGSHIP = QUERIES["article_list"]
