"""Queries and SQL of the engine, by name."""

from loomrank.plans import graphs, ingest, search  # noqa: F401
from loomrank.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
