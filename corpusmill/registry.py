"""All registered queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _bigint(sql: str) -> str:
    """DuckDB counts conditions as HUGEINT; Spark as BIGINT."""
    out, at = "", 0
    while (i := sql.find("count_if(", at)) >= 0:
        depth, j = 0, i + 8
        while True:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if not depth:
                break
            j += 1
        out += sql[at:i] + f"CAST({sql[i : j + 1]} AS BIGINT)"
        at = j + 1
    return out + sql[at:]


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` follows the shared input views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            from .plans.inputs import VIEWS

            ORACLE[f.__name__] = _bigint(VIEWS + sql)
        return f

    return add


from .plans import answers, corpus, facts, graphs, lifecycle, records, retrieval, streams  # noqa: E402,F401
