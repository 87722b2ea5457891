"""Every query by name, and its SQL."""

from __future__ import annotations

from .queries import QUERIES
from .sql import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
