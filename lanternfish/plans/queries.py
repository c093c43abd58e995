"""All queries of the core, and their SQL."""

from __future__ import annotations

from lanternfish.plans import catalogues, corpus, flows, retrieval, rules  # noqa: F401 - they register their queries
from lanternfish.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
