"""Registered queries and their SQL."""

from . import clusters, entities, feeds, graphs, jobs, models, ranks, relations, words  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
