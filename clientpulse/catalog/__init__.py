"""Registered queries and their DuckDB twins, by inventory group."""

from clientpulse.catalog import answers, evaluation, features, modelling, preparation, relational, selection
from clientpulse.catalog.base import Query

MODULES = (relational, features, selection, preparation, modelling, evaluation, answers)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for query in module.QUERIES:
            if query.key in found:
                raise ValueError(f"duplicate query {query.key}")
            found[query.key] = query
    return found
