"""All registered queries; importing a query module registers what it holds."""
from __future__ import annotations

from pixelwarrant.plans import queries_dataset, queries_evidence, queries_grid, queries_metrics, queries_models, queries_regions  # noqa: F401
from pixelwarrant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
