"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name, with the equivalent SQL if there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLE[function.__name__] = oracle
        return function

    return add


def sql_values(rows: list[tuple], columns: list[str]) -> str:
    """A derived table of constants, for oracles over inline fixtures."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(literal(x) for x in v) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows) + ") AS t(" + ", ".join(columns) + ")"
