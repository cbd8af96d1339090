"""The registered queries and their oracle SQL."""

from __future__ import annotations

from .oracle import ORACLE
from .queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
