"""Named queries over the derived panel, and the SQL that each is checked against."""

from __future__ import annotations

from . import book_queries, file_queries, model_queries, risk_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
