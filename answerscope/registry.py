"""The registry of named queries and of their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _counted(sql: str) -> str:
    """``count_if(x)`` as a count of 64 bits, as Spark's is."""
    while (a := sql.find("count_if(")) >= 0:
        b, depth = a + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[b], 0)
            b += 1
        sql = f"{sql[:a]}count(case when {sql[a + 9 : b - 1]} then 1 end){sql[b:]}"
    return sql


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = _counted(sql)
        return f

    return add
