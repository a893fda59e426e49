"""All registered queries."""

from __future__ import annotations

from curveloom.registry import curves, entities, errors, jobs, models
from curveloom.registry.book import Query

BOOKS = (errors, entities, curves, models, jobs)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in BOOKS:
        overlap = found.keys() & module.book.queries.keys()
        if overlap:
            raise ValueError(f"queries registered twice: {sorted(overlap)}")
        found.update(module.book.queries)
    return found


def all_sql() -> dict[str, str]:
    return {name: sql for module in BOOKS for name, sql in module.book.sql.items()}
