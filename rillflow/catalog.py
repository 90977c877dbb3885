"""All registered queries of the library, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import basic, changes, databases, ordered, streams, warehouse, windowed

MODULES = (basic, windowed, ordered, warehouse, streams, changes, databases)
FLAGSHIP = "w10_province_stats"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
