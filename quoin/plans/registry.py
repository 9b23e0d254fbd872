"""All queries of the engine with their SQL, by name."""

from __future__ import annotations

from . import record_queries, scoring_queries, span_queries, text_queries  # noqa: F401  they register themselves
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
