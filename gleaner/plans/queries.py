"""The registered queries for the collection operators, each with its SQL."""

from __future__ import annotations

from gleaner.plans import dashboards, listing, near, retrieval, workflows  # noqa: F401  (each registers its queries)
from gleaner.plans.listing import FLAGSHIP
from gleaner.plans.registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
