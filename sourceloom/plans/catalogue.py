"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from . import analytics, answers, asking, details, domains, intake, matching, records, retrieval, understanding
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "answers", "asking", "details", "domains", "intake", "matching", "records", "retrieval", "understanding"]
