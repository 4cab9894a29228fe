"""Registered queries and the SQL they are held against."""

from sessionloom.plans import aggregates, changes, clustering, decisions, models, registries, relational, remaining, scalars  # noqa: F401
from sessionloom.plans.registry import ORACLES, QUERIES

__all__ = ["oracle_sql", "queries"]


def queries():
    """Every query of the library by name."""
    return QUERIES


def oracle_sql():
    """The DuckDB SQL of the queries that have one."""
    return ORACLES
