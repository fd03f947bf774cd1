"""All queries over the driver's tables, with the SQL that checks each."""

from __future__ import annotations

from . import artifacts, corpus, events, payments, reconciliation  # noqa: F401  each registers its queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
