"""Registry of runnable queries and their SQL twins.

A query is a function (spark, folder) -> DataFrame over the given tables.  Its
SQL twin is one SELECT; shared sub-selects are named views that are prepended
as CTEs in dependency order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}
RECURSIVE: set[str] = set()


def view(name: str, sql: str, recursive: bool = False) -> None:
    if name in VIEWS:
        raise ValueError(f"duplicate view {name}")
    VIEWS[name] = sql
    if recursive:
        RECURSIVE.add(name)


def compose(body: str) -> str:
    names = _ordered(body)
    if not names:
        return body
    ctes = ",\n".join(
        f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({VIEWS[n]})" for n in names
    )
    keyword = "WITH RECURSIVE" if any(n in RECURSIVE for n in names) else "WITH"
    if body.lstrip().startswith("WITH "):
        return f"{keyword} {ctes},\n{body.lstrip()[5:]}"
    return f"{keyword} {ctes}\n{body}"


def _ordered(body: str) -> list[str]:
    order: list[str] = []

    def visit(sql: str, stack: tuple[str, ...]) -> None:
        for name in VIEWS:
            if name in stack or name in order:
                continue
            if re.search(rf"\b{name}\b", sql):
                visit(VIEWS[name], stack + (name,))
                order.append(name)

    visit(body, ())
    return order


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the body of its twin (views are added)."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def oracle_sql() -> dict[str, str]:
    return {name: compose(body) for name, body in SQL.items()}
