"""All queries over the given tables: importing the modules registers them."""

from __future__ import annotations

from . import account_queries, curve_queries, document_queries, learning_queries, pairing_queries, pixel_queries, source_queries, trace_queries, training_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
