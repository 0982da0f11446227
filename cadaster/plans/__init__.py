"""The library's registered queries, by area; each module has QUERIES and SQL."""

from importlib import import_module

AREAS = ("comparables", "scalars", "quotes", "corpus", "accounts", "companies", "answers", "grids", "streaming")


def all_queries() -> dict:
    return {k: v for area in AREAS for k, v in import_module(f"cadaster.plans.{area}").QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {k: v for area in AREAS for k, v in import_module(f"cadaster.plans.{area}").SQL.items()}
