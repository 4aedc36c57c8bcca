"""All registered queries."""

from __future__ import annotations

from . import code_queries, fact_queries, graph_queries, ledger_queries, pareto_queries, parsing_queries, population_queries, routing_queries, similarity_queries, stat_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
