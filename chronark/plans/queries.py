"""All queries of the library."""

from chronark.plans import catalog_queries, fact_queries, gate_queries, more_queries, series_queries, text_queries, write_queries  # noqa: F401
from chronark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
