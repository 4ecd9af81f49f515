"""Every query of the engine by name, and the SQL that checks it."""

from __future__ import annotations

from .queries import codes, cut, draws, logs, records, tables, trajectory  # noqa: F401
from .queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
