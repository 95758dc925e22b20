"""Queries by name, with their DuckDB twins where SQL can express them."""

from __future__ import annotations

from descmap.plans import more  # noqa: F401  its queries register themselves
from descmap.plans.catalog import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
