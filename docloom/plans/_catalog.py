"""The catalogue: each registered query with the SQL that it must equal, where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Concepts as SQL over the driver's tables; ``views.py`` has the same as DataFrames.
VIEW_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """sql with a common table expression for each view that it names, and those that these name."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEW_SQL[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ", ".join(f"{n} AS ({VIEW_SQL[n]})" for n in needed)
    body = sql.strip()
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        return f"WITH {m[1] or ''}{head}, {body[m.end():]}"
    return f"WITH {head} {body}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql)
        return f

    return register
