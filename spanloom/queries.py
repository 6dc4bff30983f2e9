"""All queries of the core."""

from __future__ import annotations

from .plans import audit, evaluate, gates, mixtures, relational, screen, spans, streams, texts  # noqa: F401  (they register themselves)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
