"""Named queries and, where SQL can say the same, the DuckDB text they are checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parcelscope.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# shared DuckDB sub-queries; a query text may use any of these names
SHARED_SQL: dict[str, str] = {}


def shared(name: str, sql: str) -> None:
    SHARED_SQL[name] = sql


def _needed(text: str, seen: list[str]) -> list[str]:
    for name, body in SHARED_SQL.items():
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(body, seen)
            if name not in seen:
                seen.append(name)
    return seen


def full_sql(text: str) -> str:
    """Put the shared sub-queries a text uses in front of it."""
    text = text.strip()
    names = _needed(text, [])
    if not names:
        return text
    head = ",\n".join(f"{n} as (\n{SHARED_SQL[n].strip()}\n)" for n in names)
    if text[:5].lower() == "with ":
        return f"with {head},\n{text[5:]}"
    return f"with {head}\n{text}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
