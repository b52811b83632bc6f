"""Registry of queries: a key, a function of Tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.sources.fixtures import ADAPTERS, Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
#: The time at which recency is judged: the end of the events.
AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def query(key: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[key] = with_adapters(sql)
        return f

    return add


def with_adapters(sql: str) -> str:
    """sql, headed by the adapters that it names (and those that they name)."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in ADAPTERS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(ADAPTERS[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    heads = [f"{n} AS ({ADAPTERS[n]})" for n in needed]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    if own:
        return f"WITH {own[1] or ''}" + ", ".join([*heads, sql[own.end() :]])
    return (f"WITH {', '.join(heads)} " if heads else "") + sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
