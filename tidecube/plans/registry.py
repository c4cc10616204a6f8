"""Registry of the engine's own queries and their SQL oracles."""

from . import mesh_queries, oracles
from . import queries as grid_queries


def queries():
    return grid_queries.queries() | mesh_queries.queries()


def oracle_sql():
    return oracles.oracle_sql() | mesh_queries.oracle_sql()


__all__ = ["oracle_sql", "queries"]
