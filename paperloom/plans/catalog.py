"""All queries of the engine's own operators."""

from __future__ import annotations

from paperloom.plans import graph_queries, metrics_queries, source_queries, stream_queries, text_queries, validate_queries  # noqa: F401  they register themselves
from paperloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
