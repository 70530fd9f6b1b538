"""Where queries are registered with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog_view import CATALOG_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WITH = "WITH" + CATALOG_SQL


def query(sql: str, with_catalog: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = (_WITH + ("," if sql.lstrip().startswith(("t AS", "w AS", "x AS")) else "") if with_catalog else "") + sql
        return f

    return add
