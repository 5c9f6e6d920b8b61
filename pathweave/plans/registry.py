"""Every registered query of the graph engine with its SQL."""

from __future__ import annotations

from . import graph_queries, profile_queries, semantic_queries, source_queries
from ..streaming import queries as streaming

QUERIES: dict = graph_queries.QUERIES | streaming.QUERIES
ORACLE_SQL: dict[str, str] = graph_queries.ORACLE | streaming.ORACLE

__all__ = ["ORACLE_SQL", "QUERIES", "profile_queries", "semantic_queries", "source_queries"]
