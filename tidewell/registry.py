"""All queries over the star-schema tables with the SQL that gives the same rows."""

from __future__ import annotations

from tidewell.queries import design, effects, injection, quality, relational, replies  # noqa: F401  they register themselves
from tidewell.queries.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
