"""All registered queries and their SQL."""

from __future__ import annotations

from tesserae.plans import captures, folders, layouts, rooms, rules, scoring, sequences, spatial, stitching, views  # noqa: F401
from tesserae.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
