"""All queries of the engine by name, with the SQL that DuckDB holds them against."""

from __future__ import annotations

from .plans import more_queries, pose_queries, retrieval_queries, sequence_queries, source_queries  # noqa: F401  (they register themselves)
from .plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
