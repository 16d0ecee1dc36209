"""Registers queries with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans.tables import BASE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a (spark, sf_dir) -> DataFrame function; ``sql`` may use the derived tables of ``plans.tables``."""

    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            base = BASE_SQL
            if body.upper().startswith("WITH RECURSIVE "):
                base, body = base.replace("WITH ", "WITH RECURSIVE ", 1), "WITH " + body[15:]
            ORACLES[name] = f"{base}, {body[5:]}" if body.upper().startswith("WITH ") else f"{base} {body}"
        return f

    return add
