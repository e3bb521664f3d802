"""All registered queries of the document engine, by name."""

from __future__ import annotations

from . import core, domains, layouts, small, structures  # noqa: F401  (they register their queries)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
