"""Registered queries of the library, gathered from the modules of this package."""

from __future__ import annotations

from docloom.plans import aggregates, filters, graphs, retrieval, scalars, upkeep, windows
from docloom.plans._catalog import QUERIES, SQL, Query

__all__ = ["aggregates", "filters", "graphs", "retrieval", "scalars", "upkeep", "windows"]
FLAGSHIP = "rag_context"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
