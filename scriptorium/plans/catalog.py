"""All queries over the driver's tables, with the DuckDB SQL of each."""

from __future__ import annotations

from scriptorium.plans import parses, relational, reports, stores, texts  # noqa: F401  they register their queries
from scriptorium.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
