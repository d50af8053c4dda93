"""All queries by name, with the SQL that must give the same rows."""

from __future__ import annotations

from . import documents, notes, parsing, relations, scalars  # noqa: F401  each registers its queries
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
